"""Globs as regular expressions and as LIKE patterns; checked on the driver, run in the scan."""

from __future__ import annotations

import re

MAX_LENGTH, MAX_WILDCARDS, MAX_GROUPS, MAX_ITEMS = 200, 10, 5, 20


def problem(pattern: str) -> str | None:
    """What is wrong with a glob: empty, unbalanced, or beyond the safety limits."""
    if not pattern or not pattern.strip():
        return "empty pattern"
    if len(pattern) > MAX_LENGTH:
        return f"longer than {MAX_LENGTH} characters"
    square = braces = groups = k = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            square += 1
        elif c == "]" and square:
            square -= 1
        elif c == "{":
            braces, groups = braces + 1, groups + 1
        elif c == "}":
            if not braces:
                return "unbalanced braces"
            braces -= 1
        k += 1
    if square:
        return "unbalanced brackets"
    if braces:
        return "unbalanced braces"
    if len(re.findall(r"\*+|\?", pattern)) > MAX_WILDCARDS:
        return f"more than {MAX_WILDCARDS} wildcards"
    if groups > MAX_GROUPS:
        return f"more than {MAX_GROUPS} brace groups"
    if any(x.count(",") + 1 > MAX_ITEMS for x in re.findall(r"\{([^{}]*)\}", pattern)):
        return f"more than {MAX_ITEMS} items in braces"
    return None


def to_regex(pattern: str) -> str:
    """An anchored regular expression (Java and Python alike): ``*`` and ``?`` stay
    inside a path segment, ``**`` spans any number of them, dotfiles match."""
    out, k, n = [], 0, len(pattern)
    depth = 0
    while k < n:
        c = pattern[k]
        if c == "*":
            whole = pattern[k : k + 2] == "**" and (k == 0 or pattern[k - 1] in "/{,") and (k + 2 == n or pattern[k + 2] in "/},")
            if whole and pattern[k + 2 : k + 3] == "/":
                out.append("(?:[^/]+/)*")
                k += 3
                continue
            if whole:
                out.append(".*")
                k += 2
                continue
            out.append("[^/]*")
            while k + 1 < n and pattern[k + 1] == "*":
                k += 1
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", k + 2)
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[k + 1 : end]
                out.append("[" + ("^" if body[0] in "!^" else "") + body.lstrip("!^").replace("\\", "\\\\").replace("[", "\\[") + "]")
                k = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and k + 1 < n:
            k += 1
            out.append(re.escape(pattern[k]))
        else:
            out.append(re.escape(c) if c in r".^$+()|]}" else c)
        k += 1
    return f"^{''.join(out)}$"


def any_regex(patterns: list[str]) -> str:
    """One alternation of several globs, each also without a leading ``./``."""
    return "|".join(f"(?:{to_regex(p.removeprefix('./'))})" for p in patterns) or "(?!)"


def literal_prefix(pattern: str) -> str:
    """What every match begins with: pushed down to the scan as startswith."""
    return re.match(r"[^*?\[\]{}\\]*", pattern)[0]


def to_like(pattern: str) -> str:
    """A LIKE pattern with ``\\`` as its escape: ``*`` crosses segments here."""
    out = []
    for part in re.split(r"(\*+|\?)", pattern):
        out.append("%" if part.startswith("*") else "_" if part == "?" else re.sub(r"([%_\\])", r"\\\1", part))
    return "".join(out)


def gitignore_rules(lines: list[str], base: str = "") -> list[tuple[bool, str]]:
    """(ignores, regular expression) of each rule in order; the last that matches decides."""
    out = []
    for line in lines:
        rule = line.rstrip("\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        ignores = not rule.startswith("!")
        rule = rule if ignores else rule[1:]
        rule = rule.removeprefix("\\")
        only_dir = rule.endswith("/")
        rule = rule.rstrip("/")
        anchored = "/" in rule
        rule = rule.lstrip("/")
        glob = to_regex(rule)[1:-1]
        where = "" if anchored else "(?:.*/)?"
        tail = "/.*" if only_dir else "(?:/.*)?"
        out.append((ignores, f"^{re.escape(base + '/') if base else ''}{where}{glob}{tail}$"))
    return out
