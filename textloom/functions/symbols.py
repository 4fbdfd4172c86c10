"""What a source file holds: symbols, imports, exports, comments, lines, complexity.

Python is read by its own parser; other languages line by line with patterns, which
finds declarations and comments but not the tree below them."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from dataclasses import dataclass, field

from .query import half_up
from .splitters import _first

MAX_SIZE = 1 << 20
MIN_COMMENT, MAX_COMMENT = 20, 10_000
_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_DECLARED = {
    "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:public\s+|private\s+|protected\s+|static\s+)*(?:async\s+)?(?:function\*?|fn|func|fun|def)\s+(?:\([^)]*\)\s*)?(\w+)",
    "class": r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+|pub\s+)*(?:class|interface|struct|trait|enum|record|object)\s+(\w+)",
    "import": r"^\s*(?:import\s+.*?[\"']([^\"']+)[\"']|import\s+([\w.*]+)|use\s+([\w:]+)|#include\s*[<\"]([^>\"]+)[>\"]|.*\brequire\(\s*[\"']([^\"']+)[\"'])",
    "export": r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+(\w+)",
}
_DECLARED = {k: re.compile(v) for k, v in _DECLARED.items()}
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|elif|when)\b|&&|\|\||\?(?![.:?])")


@dataclass
class Comment:
    text: str
    start_line: int
    end_line: int
    type: str
    symbol: str | None = None
    tags: list[tuple[str, str, str, str]] = field(default_factory=list)  #: name, value, parameter, its type


@dataclass
class Summary:
    functions: list[tuple[str, int, int, int, int]] = field(default_factory=list)  #: name, first and last line, complexity, nesting
    classes: list[str] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    total: int = 0
    blank: int = 0
    comment: int = 0
    decisions: int = 0

    @property
    def code(self) -> int:
        return max(0, self.total - self.blank - self.comment)

    def complexity(self) -> dict:
        """Sum, mean and deepest nesting over the functions, and a score from 100 down."""
        total = sum(f[3] for f in self.functions)
        mean = total / len(self.functions) if self.functions else 0.0
        deep = max((f[4] for f in self.functions), default=0)
        return {"cyclomatic": total, "max_nesting": deep, "avg": half_up(mean), "decisions": self.decisions, "score": score(total, mean, deep, len(self.functions))}


# Penalties by (limit above which, points), largest first.
PENALTIES = {
    "total": ((50, 20), (30, 15), (20, 10), (10, 5)),
    "mean": ((15, 15), (10, 10), (5, 5)),
    "nesting": ((6, 15), (4, 10), (3, 5)),
    "functions": ((50, 10), (30, 5)),
}


def score(total: float, mean: float, nesting: float, functions: int) -> int:
    lost = sum(next((p for limit, p in PENALTIES[k] if v > limit), 0) for k, v in (("total", total), ("mean", mean), ("nesting", nesting), ("functions", functions)))
    return max(0, min(100, 100 - lost))


def _decisions(node: ast.AST) -> int:
    return sum(isinstance(n, _DECISIONS) for n in ast.walk(node)) + sum(len(n.values) - 1 for n in ast.walk(node) if isinstance(n, ast.BoolOp))


def _nesting(node: ast.AST) -> int:
    return max((_nesting(c) for c in ast.iter_child_nodes(node)), default=0) + isinstance(node, _NESTING)


def comment_lines(text: str, language: str) -> set[int]:
    if language == "python":
        try:
            return {t.start[0] for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT}
        except (tokenize.TokenError, SyntaxError, IndentationError):
            return {k for k, line in enumerate(text.split("\n"), 1) if line.lstrip().startswith("#")}
    out, inside = set(), False
    for k, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if inside or bare.startswith(("//", "/*")) or language in ("ruby", "shell", "yaml") and bare.startswith("#"):
            out.add(k)
        if bare.startswith("/*"):
            inside = True
        if inside and "*/" in bare:
            inside = False
    return out


def summarize(text: str, language: str) -> Summary | None:
    """None above a megabyte. An unknown language has its lines counted alone."""
    if len(text) > MAX_SIZE:
        return None
    lines = text.split("\n")
    out = Summary(total=len(lines), blank=sum(not x.strip() for x in lines), comment=len(comment_lines(text, language)))
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return out
        out.decisions = _decisions(tree)
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.functions.append((n.name, _first(n), n.end_lineno, 1 + _decisions(n), _nesting(n)))
            elif isinstance(n, ast.ClassDef):
                out.classes.append(n.name)
            elif isinstance(n, ast.Import):
                out.imports += [a.name for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.imports.append("." * n.level + (n.module or ""))
        out.functions.sort(key=lambda f: f[1])
        out.exports = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and not n.name.startswith("_")]
        return out
    if language == "unknown":
        return out
    for k, line in enumerate(lines, 1):
        for kind, pattern in _DECLARED.items():
            if m := pattern.match(line):
                name = next(g for g in m.groups() if g)
                if kind == "function":
                    end, branches, deepest = _brace_end(lines, k - 1)
                    out.functions.append((name, k, end, 1 + branches, deepest))
                else:
                    getattr(out, {"class": "classes", "import": "imports", "export": "exports"}[kind]).append(name)
    out.decisions = sum(len(_BRANCH.findall(x)) for x in lines)
    return out


def _brace_end(lines: list[str], at: int) -> tuple[int, int, int]:
    """Last line of a unit in braces from line ``at``, its branches and deepest nesting."""
    depth = deepest = branches = 0
    for k in range(at, len(lines)):
        branches += len(_BRANCH.findall(lines[k]))
        for c in lines[k]:
            depth += (c == "{") - (c == "}")
            deepest = max(deepest, depth)
        if deepest and depth <= 0:
            return k + 1, branches, deepest
        if not deepest and lines[k].rstrip().endswith(";"):
            return k + 1, branches, 0
    return len(lines), branches, deepest


_TAG = re.compile(r"@(\w+)(?:[ \t]+\{([^}]*)\})?(?:[ \t]+(.*))?")
_PY_FIELD = re.compile(r"^\s*:(\w+)(?:\s+([^:]*?))?:\s*(.*)$")
_PY_ENTRY = re.compile(r"^(\*{0,2}\w+)\s*(?:\(([^)]*)\))?:\s*(.*)$")
_PY_TYPED = re.compile(r"^([\w.\[\], |]+):\s+(.*)$")
#: sections of a docstring, by the tag of their entries (fixed values)
_SECTIONS = {"args": "param", "arguments": "param", "parameters": "param", "params": "param", "attributes": "property", "returns": "returns", "return": "returns", "yields": "yields", "yield": "yields", "raises": "throws", "raise": "throws", "throws": "throws", "example": "example", "examples": "example", "note": "note", "notes": "note"}
_FIELDS = {"param": "param", "parameter": "param", "arg": "param", "return": "returns", "returns": "returns", "raises": "throws", "raise": "throws", "rtype": "rtype", "type": "type"}


def _docstring(text: str) -> tuple[str, list[tuple[str, str, str, str]]]:
    """The body of a docstring, and the tags of its sections and fields."""
    body: list[str] = []
    tags: list[list[str]] = []
    section, indent = None, 0
    for line in text.split("\n"):
        bare, depth = line.strip(), len(line) - len(line.lstrip())
        if m := _PY_FIELD.match(line):
            if kind := _FIELDS.get(m[1]):
                tags.append([kind, m[3].strip(), *(("", (m[2] or "").strip()) if kind == "throws" else ((m[2] or "").strip(), ""))])
                continue
        title = bare.removesuffix(":").lower()
        if bare.endswith(":") and title in _SECTIONS and (section is None or depth <= indent):
            section, indent = _SECTIONS[title], depth
        elif section is not None and bare and depth <= indent:
            section = None
            body.append(line)
        elif section is None:
            body.append(line)
        elif not bare:
            continue
        elif section in ("param", "property") and (m := _PY_ENTRY.match(bare)):
            tags.append([section, m[3], m[1], m[2] or ""])
        elif section == "throws" and (m := _PY_TYPED.match(bare)):
            tags.append([section, m[2], "", m[1]])
        elif section in ("returns", "yields") and (not tags or tags[-1][0] != section):
            m = _PY_TYPED.match(bare)
            tags.append([section, m[2] if m else bare, "", m[1] if m else ""])
        elif tags and tags[-1][0] == section:
            tags[-1][1] = f"{tags[-1][1]} {bare}".strip()
        else:
            tags.append([section, bare, "", ""])
    return "\n".join(body).strip(), [tuple(t) for t in tags]


def tags_of(text: str, style: str = "block") -> list[tuple[str, str, str, str]]:
    """(name, value, parameter, its type) of the tags of a doc comment. Of ``raises`` the type
    is the exception's, of ``returns`` the value's."""
    if style == "python":
        return _docstring(text)[1]
    out = []
    for m in _TAG.finditer(text):
        rest = (m[3] or "").strip()
        of = ""
        if m[1] in ("param", "arg", "argument", "property") and rest:
            of, _, rest = rest.partition(" ")
            rest = rest.lstrip("- ")
        out.append((m[1], rest, of, m[2] or ""))
    return out


def without_tags(text: str) -> str:
    """The body of a doc comment: all before its first tag line."""
    m = re.search(r"^\s*@\w+", text, re.M)
    return (text[: m.start()] if m else text).strip()


def cleaned(text: str) -> str:
    """A block comment without its markers."""
    inner = re.sub(r"^\s*/\*+!?|\*+/\s*$", "", text.strip())
    return "\n".join(re.sub(r"^\s*(?:\*+|///?!?|#+)? ?", "", x) for x in inner.split("\n")).strip()


def comments(text: str, language: str, least: int = MIN_COMMENT, most: int = MAX_COMMENT) -> list[Comment]:
    """Doc comments with the symbol that they belong to: docstrings of Python, /** blocks
    and runs of /// elsewhere; too short or too long ones are left out."""
    out, sizes = [], []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        for n in ast.walk(tree):
            if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and (doc := ast.get_docstring(n)):
                at = n.body[0]
                body, tags = _docstring(doc)
                out.append(Comment(body, at.lineno, at.end_lineno, "docstring", getattr(n, "name", None), tags))
                sizes.append(len(doc))
    else:
        lines = text.split("\n")
        for m in re.finditer(r"/\*\*(?!/)[\s\S]*?\*/|(?:^[ \t]*///.*\n?)+", text, re.M):
            first = text.count("\n", 0, m.start()) + 1
            last = first + m[0].rstrip("\n").count("\n")
            after = next((x for x in lines[last:] if x.strip()), "")
            name = next((k[1] for p in ("function", "class") if (k := _DECLARED[p].match(after))), None)
            if name is None and (k := re.match(r"\s*(?:export\s+)?(?:const|let|var|pub|public|private|static|type)\s+(?:\w+\s+)*?(\w+)\s*[=(:]", after)):
                name = k[1]
            body = cleaned(m[0])
            out.append(Comment(without_tags(body), first, last, "doc", name, tags_of(body)))
            sizes.append(len(body))
    kept = [c for c, n in zip(out, sizes, strict=True) if least <= n <= most]
    return sorted(kept, key=lambda c: c.start_line)


def comment_text(c: Comment) -> str:
    """What the index holds of a comment."""
    parts = [f"{c.type}: {c.symbol}" if c.symbol else "", c.text, *(f"@{n} {p} {v}".replace("  ", " ").strip() for n, v, p, _ in c.tags)]
    return "\n\n".join(p for p in parts if p)
