import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import splitters as S
from textloom.functions import symbols


def test_short_text_is_one_chunk():
    assert S.by_characters("hello\nworld\n") == [S.Chunk("hello\nworld\n", 1, 2)]
    assert S.by_characters("") == []


def test_separators_in_order_and_overlap():
    text = "\n\n".join("x" * 30 for _ in range(6))
    out = S.split(text, 100, 40)
    assert all(len(c) <= 100 for c in out) and out[1].startswith("x" * 30)
    assert S.split("abcdefghij", 4, 1, ("",)) == ["abcd", "defg", "ghij"]
    with pytest.raises(S.TooManyChunks):
        S.split("x" * 1000, 10, 0, most=5)


@settings(max_examples=60)
@given(st.text(alphabet="ab \n.", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_chunks_cover_the_text_and_fit(text, size, overlap):
    overlap = min(overlap, size - 1)
    out = S.split(text, size, overlap, most=None)
    assert all(0 < len(c) <= size for c in out)
    assert set("".join(out)) == set(text)
    if overlap == 0:
        assert "".join(out) == text
    for c in S.numbered(text, out, overlap):
        assert 1 <= c.start_line <= c.end_line


def test_line_numbers():
    text = "\n".join(f"line {k}" for k in range(200))
    for c in S.by_characters(text, 120, 0):
        assert c.text.split("\n")[0] == f"line {c.start_line - 1}" or c.text.startswith("\n")


def test_markdown():
    text = "---\nt: 1\n---\nintro\n\n# One\n\nbody\n\n## Two\n\n```\n# not a header\n```\n\nSet\n===\n\nend"
    found = S.sections(text)
    assert [(s.level, s.title, s.path) for s in found] == [(0, "", ()), (1, "One", ("One",)), (2, "Two", ("One", "Two")), (1, "Set", ("Set",))]
    assert found[1].start_line == 6
    assert S.by_markdown(text)[2].text.startswith("[One > Two]")
    big = "# Big\n\n" + "\n\n".join("p" * 3000 for _ in range(6))
    parts = S.by_markdown(big)
    assert len(parts) > 1 and "(continued)" in parts[1].text and parts[0].name == "Big"


def test_code_boundaries():
    py = "import x\n\n@dec\ndef a():\n    pass\n\nclass B:\n    def m(self):\n        pass\n"
    assert S.boundaries(py, "python") == [2, 6, 7]
    assert S.boundaries("export function a() {}\nconst b = 1\n  nested()\n", "typescript") == [0, 1]
    long = "\n\n".join(f"def f{k}():\n    return {'1 + ' * 200}1" for k in range(20))
    out = S.by_code(long, "python")
    assert len(out) > 1 and all(len(c.text) <= 4300 for c in out) and all("def f" in c.text for c in out)
    assert S.by_code("x" * 5000, "unknown") is None


def test_python_units():
    src = '"""mod"""\nclass A(B):\n    """doc"""\n    @property\n    def p(self) -> int:\n        return 1\n\nasync def f(a, b=2):\n    pass\n'
    units = {u.name: u for u in S.by_syntax(src, "python")}
    assert units["A"].type == "class" and units["A"].docstring == "doc"
    assert units["p"].parent == "A" and "property" in units["p"].tags and units["p"].signature == "def p(self) -> int"
    assert units["f"].tags == ("async",)
    assert S.by_syntax("x = 1", "python")[0].type == "module"
    assert S.by_syntax("def (", "python") is None
    assert S.chunks("def (", "a.py", "python", "ast")[0].text == "def ("


def test_symbols_and_score():
    s = symbols.summarize("# c\nimport os\n\ndef f(x):\n    if x and x > 1:\n        for y in x:\n            pass\n", "python")
    assert s.functions[0][0] == "f" and s.functions[0][3] == 4 and s.imports == ["os"] and s.comment == 1 and s.blank == 2
    assert symbols.score(0, 0, 0, 0) == 100 and symbols.score(51, 16, 7, 51) == 40 and symbols.score(11, 6, 4, 31) == 80
    js = symbols.summarize("import a from 'b'\nexport class C {}\nfunction f() { if (x) { y() } }\n", "javascript")
    assert js.classes == ["C"] and js.imports == ["b"] and js.exports == ["C"] and js.functions[0][0] == "f"
    assert symbols.summarize("x" * (symbols.MAX_SIZE + 1), "python") is None


def test_comments():
    js = "/**\n * Adds two numbers together.\n * @param {number} a first one\n */\nfunction add(a, b) {}\n"
    c = symbols.comments(js, "javascript")[0]
    assert c.symbol == "add" and ("param", "first one", "a", "number") in c.tags and c.start_line == 1 and c.end_line == 4
    py = 'def f(x):\n    """Do something with the value.\n\n    :param x: the value\n    """\n'
    c = symbols.comments(py, "python")[0]
    assert c.symbol == "f" and c.tags[0][:3] == ("param", "the value", "x")
    assert symbols.comments('def f():\n    """short"""\n', "python") == []


def test_docstring_sections_are_tags_and_leave_the_body():
    doc = """Open a file and read all of it.

    Args:
        path (str): where it lies,
            on any disk
        mode: how

    Returns:
        int: bytes read

    Raises:
        ValueError: if empty

    More words.
    :param late: a field
    """
    body, tags = symbols._docstring(doc)
    assert body.split("\n")[0] == "Open a file and read all of it." and "More words." in body and "Args" not in body and "ValueError" not in body
    assert tags == [("param", "where it lies, on any disk", "path", "str"), ("param", "how", "mode", ""), ("returns", "bytes read", "", "int"), ("throws", "if empty", "", "ValueError"), ("param", "a field", "late", "")]
    js = "/**\n * Adds two numbers together.\n * @param {number} a - the first\n * @returns {number} the sum\n */\nfunction add(a, b) {}"
    c = symbols.comments(js, "javascript")[0]
    assert c.text == "Adds two numbers together." and symbols.comment_text(c).count("@param") == 1


def plain_split(text, size, overlap, separators):
    """The splitter part by part: what the cuts by cumulative lengths must equal."""
    sep = next((x for x in separators if x and x in text), "")
    if not sep:
        return S._slices(text, size, overlap)
    parts = [x + sep for x in text.split(sep)[:-1]] + text.split(sep)[-1:]
    out, tail, own = [], [], []
    for part in parts:
        if sum(map(len, tail + own)) + len(part) > size and "".join(tail + own):
            out.append("".join(tail + own))
            tail = []
            while own and len(own[-1]) + sum(map(len, tail)) <= overlap:
                tail.insert(0, own.pop())
            own = []
        if sum(map(len, tail + own)) + len(part) <= size:
            own.append(part)
        else:
            out += ["".join(tail + own)] * bool("".join(tail + own))
            out += plain_split(part, size, overlap, separators[separators.index(sep) + 1 :]) if len(part) > size else [part]
            tail, own = [], []
    return out + ["".join(tail + own)] * bool("".join(tail + own))


def test_cuts_by_lengths_equal_the_splitter_part_by_part():
    import random

    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice("ab c\n.") for _ in range(r.randrange(1, 160)))
        size, overlap = r.randrange(3, 30), r.randrange(0, 12)
        if len(text) > size:
            assert S._split(text, size, overlap, S.SEPARATORS) == plain_split(text, size, overlap, S.SEPARATORS), (text, size, overlap)
