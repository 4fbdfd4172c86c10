"""One text becomes chunks with line numbers: pure Python, wrapped for tables in
:mod:`textloom.operators.chunking`."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, replace
from itertools import accumulate

CHUNK, OVERLAP, MOST = 4_000, 800, 1_000
SEPARATORS = ("\n\n", "\n", " ", "")
DOC_CHUNK, DOC_OVERLAP, DOC_SEPARATORS = 8_000, 2_000, ("\n\n", "\n", ". ", " ", "")
CODE_CHUNK, CODE_OVERLAP, HARD_MOST = 4_000, 200, 8_000
SMALL_SECTION = 500


@dataclass(frozen=True)
class Chunk:
    text: str
    start_line: int
    end_line: int
    type: str | None = None
    name: str | None = None
    parent: str | None = None
    signature: str | None = None
    docstring: str | None = None
    tags: tuple[str, ...] = ()


class TooManyChunks(ValueError):
    pass


def _slices(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters; the last ends with the text."""
    step = max(size - overlap, 1)
    starts = range(0, max(len(text) - overlap, 1), step)
    return [text[s : s + size] for s in starts] if len(text) > size else [text]


def split(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, most: int | None = MOST) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that parts the
    text, pieces too large by the next one. A piece begins with the last whole parts of
    the one before that fit into ``overlap``."""
    if not text:
        return []
    out = [text] if len(text) <= size else _split(text, size, overlap, separators)
    if most is not None and len(out) > most:
        raise TooManyChunks(f"{len(out)} chunks, {most} at most")
    return out


def _split(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    sep = next((s for s in separators if s and s in text), "")
    if not sep:
        return _slices(text, size, overlap)
    ends = [0, *accumulate(len(p) + len(sep) for p in text.split(sep))]
    ends[-1] = len(text)  # nothing parts the last one from what follows
    last = len(ends) - 1
    out: list[str] = []
    first = fresh = k = 0  # parts first..k are at hand, those from fresh on in no piece yet
    while True:
        k = max(k, bisect_right(ends, ends[first] + size) - 1)
        if ends[k] > ends[first]:
            out.append(text[ends[first] : ends[k]])
        if k >= last:
            return out
        # whole parts that fit into the overlap begin the next piece
        first, fresh = max(fresh, bisect_left(ends, ends[k] - overlap)), k
        if ends[k + 1] - ends[first] > size:
            if ends[k] > ends[first]:
                out.append(text[ends[first] : ends[k]])
            part = text[ends[k] : ends[k + 1]]
            out += _split(part, size, overlap, separators[separators.index(sep) + 1 :]) if len(part) > size else [part]
            first = fresh = k = k + 1


def line_count(text: str) -> int:
    """Lines of a piece; a line feed at its end begins none."""
    return max(1, text.count("\n") + 1 - text.endswith("\n")) if text else 0


def numbered(text: str, pieces: list[str], overlap: int = OVERLAP) -> list[Chunk]:
    """Pieces with their lines from 1: each is looked for from about the end of the one
    before; one not found follows the one before."""
    out: list[Chunk] = []
    start = line = at = 0
    for piece in pieces:
        found = text.find(piece, max(0, start - len(piece)))
        if found < 0:
            first = out[-1].end_line + 1 if out else 1
        else:
            # line feeds are counted once, from the place before
            line += text.count("\n", at, found) if found >= at else -text.count("\n", found, at)
            at, first = found, line + 1
            start = max(0, found + len(piece) - overlap)
        out.append(Chunk(piece, first, first + line_count(piece) - 1))
    return out


def by_characters(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, most: int | None = MOST) -> list[Chunk]:
    return numbered(text, split(text, size, overlap, separators, most), overlap)


def by_lines(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[Chunk]:
    """For very large texts: whole lines gathered up to ``size``; a chunk begins with
    the last ``overlap`` characters of the one before."""
    out, current, first, line = [], "", 1, 0
    for part in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        line += 1
        if current and len(current) + len(part) > size:
            out.append(Chunk(current, first, line - 1))
            tail = current[-overlap:] if overlap else ""
            first = line - tail.count("\n") if tail else line
            current = tail
        current += part
    return out + [Chunk(current, first, max(first, line))] if current else out


# Markdown

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")


@dataclass(frozen=True)
class Section:
    level: int
    title: str
    path: tuple[str, ...]
    content: str
    start_line: int
    end_line: int


def front_matter(text: str) -> tuple[str, int]:
    """The text behind a leading --- block, and the lines that block had."""
    lines = text.split("\n")
    if lines[0].strip() == "---":
        for k in range(1, len(lines)):
            if lines[k].strip() in ("---", "..."):
                return "\n".join(lines[k + 1 :]), k + 1
    return text, 0


def sections(text: str) -> list[Section]:
    """Sections by header, of either style, outside of fenced code; what stands before
    the first header is a section of level 0."""
    body, skipped = front_matter(text)
    lines = body.split("\n")
    heads: list[tuple[int, int, int, str]] = []  # first line, content line, level, title
    fence = None
    for k, line in enumerate(lines):
        if m := _FENCE.match(line):
            if fence is None:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            continue
        if fence is not None:
            continue
        if m := _ATX.match(line):
            heads.append((k, k + 1, len(m[1]), (m[2] or "").strip()))
        elif k and (m := _SETEXT.match(line)) and lines[k - 1].strip() and not _ATX.match(lines[k - 1]) and (not heads or heads[-1][1] <= k - 1):
            heads.append((k - 1, k + 1, 1 if m[1][0] == "=" else 2, lines[k - 1].strip()))
    out, stack = [], []
    bounds = [(0, 0, 0, "")] * (not heads or heads[0][0] > 0) + heads
    for k, (first, inner, level, title) in enumerate(bounds):
        end = bounds[k + 1][0] if k + 1 < len(bounds) else len(lines)
        if level:
            stack = [s for s in stack if s[0] < level] + [(level, title)]
        content = "\n".join(lines[inner:end]).strip("\n")
        if level or content.strip():
            out.append(Section(level, title, tuple(t for _, t in stack) if level else (), content, skipped + first + 1, skipped + max(end, first + 1)))
    return out


def by_markdown(text: str, most: int = HARD_MOST, least: int = SMALL_SECTION) -> list[Chunk]:
    """A chunk per section behind a breadcrumb of its headers. A section above ``most``
    characters is split by paragraphs, later parts marked as continued; a part below
    ``least`` goes unless it is the only one."""
    out = []
    for s in sections(text):
        crumb = f"[{' > '.join(s.path)}]\n\n" if s.path else ""
        if len(s.content) <= most:
            parts = [s.content]
        else:
            parts = split(s.content, most, 0, ("\n\n", "\n", ". ", " ", ""), None)
            kept = [p for p in parts if len(p.strip()) >= least]
            parts = kept or parts[:1]
        for k, part in enumerate(parts):
            note = crumb if not k else crumb.replace("]\n\n", "] (continued)\n\n", 1) or "(continued)\n\n"
            if (note + part).strip():
                out.append(Chunk(note + part, s.start_line, s.end_line, "section", s.title or None))
    return out


def by_document(text: str, path: str) -> list[Chunk]:
    found = by_markdown(text) if path.lower().endswith((".md", ".markdown")) else []
    return found or by_characters(text, DOC_CHUNK, DOC_OVERLAP, DOC_SEPARATORS)


# Code

#: Beginnings of top-level units by family of languages, tested on a line from its first column.
_MODIFIERS = r"(?:(?:export|default|public|private|protected|internal|abstract|final|static|sealed|open|override|async|unsafe|inline|virtual|partial|data|case|implicit|lazy|declare|pub(?:\([^)]*\))?|extern(?:\s+\"[^\"]*\")?)\s+)*"
BOUNDARIES = {
    "script": rf"{_MODIFIERS}(?:function\b|class\s+\w|interface\s+\w|enum\s+\w|namespace\s+\w|type\s+\w+.*=|(?:const|let|var)\s+\w+)",
    "python": r"(?:async\s+)?def\s+\w+\s*\(|class\s+\w+|@\w+",
    "curly": rf"{_MODIFIERS}(?:class|interface|enum|record|struct|trait|impl|object|namespace|union|mod|module|protocol|extension|func|fun|fn|def|type|const|var|val|let|static|macro_rules!|template|typedef|package)\b|@\w+|#\[|[A-Za-z_][\w<>:*&\s,]*\b\w+\s*\([^;]*\)\s*(?:const\s*)?\{{",
    "ruby": r"(?:class|module|def)\s+\w|\w+\s+do\b",
    "shell": r"(?:function\s+\w+|\w+\s*\(\)\s*\{)",
    "sheet": r"[.#@:\w\[*][^{};]*\{|@\w+",
    "markup": r"<(?:template|script|style|head|body|section|div|main|article|header|footer|nav|form|table|\w+:\w+)\b",
    "sql": r"(?i:create|alter|drop|insert|update|delete|select|with|begin|grant)\b",
    "data": r"[\w.-]+\s*:|\"[^\"]+\"\s*:|- ",
    "block": r"(?:resource|data|variable|output|module|provider|locals|terraform|type|input|interface|enum|union|scalar|query|mutation|fragment|schema|extend|FROM|RUN|COPY|ENTRYPOINT|CMD|ENV|WORKDIR)\b",
}
FAMILY = {
    "script": "javascript typescript vue svelte", "python": "python", "curly": "java go rust csharp c cpp kotlin swift php scala",
    "ruby": "ruby", "shell": "shell", "sheet": "css scss less", "markup": "html xml", "sql": "sql", "data": "yaml json", "block": "terraform hcl graphql dockerfile",
}
_PATTERN = {lang: re.compile(BOUNDARIES[f]) for f, langs in FAMILY.items() for lang in langs.split()}


def boundaries(text: str, language: str) -> list[int]:
    """Lines (from 0) where a unit begins; in Python also methods, indented by at most
    four, and a decorator rather than what it decorates."""
    pattern = _PATTERN.get(language)
    if pattern is None:
        return []
    out = []
    previous = ""
    for k, line in enumerate(text.split("\n")):
        bare = line.lstrip()
        indent = len(line) - len(bare)
        if bare and indent <= (4 if language == "python" else 0) and pattern.match(bare) and not (language == "python" and previous.startswith("@")):
            out.append(k)
        previous = bare or previous
    return out


def by_code(text: str, language: str, size: int = CODE_CHUNK, overlap: int = CODE_OVERLAP, most: int = HARD_MOST) -> list[Chunk] | None:
    """Chunks that end where units begin; each but the first begins with whole lines of
    the one before, ``overlap`` characters at most. A unit above ``most`` characters is cut
    by characters. None if the language is unknown or no unit begins anywhere."""
    if not text.strip():
        return []
    if len(text) <= size:
        return [Chunk(text, 1, line_count(text))]
    starts = boundaries(text, language)
    if not starts:
        return None
    lines = text.split("\n")
    cuts = sorted({0, *starts, len(lines)})
    units = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    groups: list[list[int]] = []
    for a, b in units:
        n = sum(len(x) + 1 for x in lines[a:b])
        if groups and groups[-1][2] + n <= size:
            groups[-1][1], groups[-1][2] = b, groups[-1][2] + n
        else:
            groups.append([a, b, n])
    out = []
    for a, b, n in groups:
        body = "\n".join(lines[a:b])
        if n > most:
            out += [replace(c, start_line=c.start_line + a, end_line=c.end_line + a) for c in by_characters(body, size, overlap, most=None)]
            continue
        first, room = a, overlap
        while out and first and len(lines[first - 1]) + 1 <= room:
            first -= 1
            room -= len(lines[first]) + 1
        out.append(Chunk("\n".join(lines[first:b]), first + 1, b))
    return out


# Python syntax trees


def _first(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def python_units(text: str) -> list[Chunk] | None:
    """A chunk per function, method and class of Python source, classes' own with their
    methods' besides; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = text.split("\n")
    out: list[Chunk] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                a, b = _first(child), child.end_lineno
                of_class = isinstance(child, ast.ClassDef)
                kind = "class" if of_class else "method" if parent else "function"
                names = [ast.unparse(d).split("(")[0] for d in child.decorator_list]
                tags = ["async"] if isinstance(child, ast.AsyncFunctionDef) else []
                tags += [t for t, d in (("static", "staticmethod"), ("classmethod", "classmethod"), ("property", "property")) if d in names]
                tags += ["constructor"] if child.name == "__init__" and parent else []
                head = f"class {child.name}" if of_class else f"def {child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                if of_class and child.bases:
                    head += f"({', '.join(map(ast.unparse, child.bases))})"
                out.append(Chunk("\n".join(lines[a - 1 : b]), a, b, kind, child.name, parent, head, ast.get_docstring(child), tuple(tags)))
                if of_class:
                    visit(child, child.name)
            elif isinstance(child, (ast.If, ast.Try, ast.With)):
                visit(child, parent)

    visit(tree, None)
    return out


def by_syntax(text: str, language: str, most: int = HARD_MOST) -> list[Chunk] | None:
    """Units of a syntax tree; a module without one is a chunk; a unit above ``most`` is
    split, its parts tagged partial. None where there is no parser or it fails."""
    if language != "python":
        return None
    units = python_units(text)
    if units is None:
        return None
    units = units or [Chunk(text, 1, line_count(text), "module", docstring=ast.get_docstring(ast.parse(text)))]
    out = []
    for u in units:
        if len(u.text) <= most:
            out.append(u)
        else:
            out += [replace(u, text=c.text, start_line=u.start_line + c.start_line - 1, end_line=u.start_line + c.end_line - 1, tags=(*u.tags, "partial")) for c in by_characters(u.text, most, 0, most=None)]
    return out


def chunks(text: str, path: str, language: str, strategy: str = "character", streaming_from: int = 10 << 20) -> list[Chunk]:
    """character; code-aware (falls back to character); ast (falls back to code-aware); document."""
    if not text:
        return []
    if strategy == "document":
        return by_document(text, path)
    found = None
    if strategy == "ast":
        found = by_syntax(text, language)
    if found is None and strategy in ("ast", "code-aware"):
        found = by_code(text, language)
    if found is None:
        found = by_lines(text) if len(text) > streaming_from else by_characters(text)
    return found
