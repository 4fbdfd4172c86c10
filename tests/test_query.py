from hypothesis import given
from hypothesis import strategies as st

from textloom.functions import globs
from textloom.functions.query import detect, entity_like, expand, expansion_terms, has_expansion, parse_terms, tokens, type_boosts


def test_expansion_keeps_order_and_never_repeats_query_words():
    x = expand("auth token")
    assert x.applied == ("auth", "token")
    assert x.expanded == "auth token authentication authorize authorization login logout session jwt bearer"
    assert expand("  ").expanded == "  "
    assert expand("zzz").expanded == "zzz"
    assert len(expand("api http request db").terms) == 10
    assert expand("auth", enabled=False).terms == ()
    assert expand("foo", custom={"foo": "bar baz"}).expanded == "foo bar baz"
    assert has_expansion("API") and expansion_terms("var") == ["variable"]


@given(st.text(max_size=60))
def test_expansion_begins_with_the_query(q):
    x = expand(q)
    assert x.expanded.startswith(q.strip()) or not q.strip()
    assert len(set(x.terms)) == len(x.terms) <= 10


def test_tokens():
    assert tokens("getUserById_fast-path 2x") == ["get", "user", "by", "id", "fast", "path", "2x"]
    assert tokens("") == []


def test_entity_like():
    assert entity_like("UserService") and entity_like("user model")
    assert not entity_like("find user") and not entity_like("a b c d")
    assert entity_like("FooBar x")
    assert not entity_like("myUserService x")
    assert not entity_like("one two three")


def test_intents():
    auth = detect("login token session")
    assert auth.primary == "auth" and auth.matches[0].confidence == 1.0
    one = detect("login")
    assert one.matches[0].confidence == 0.85
    assert detect("handle the error").matches[0].category == "error"
    assert detect("handle the error").matches[0].confidence == 1.0
    assert detect("PaymentService").matches[0].category == "class"  # by the keyword service
    assert detect("FooBar").primary is None  # the class pattern never sees capitals
    assert len(detect("test api database config login error class").matches) == 3
    assert detect("x", enabled=False).matches == ()
    assert detect("login").has("auth", 0.8) and not detect("login").has("api")


def test_type_boost_profiles():
    assert type_boosts(detect("class foo"))["class"] == 1.3
    assert type_boosts(detect("zzz yyy"))["class"] == 1.15
    assert type_boosts(detect("how does the function work here"))["function"] == 1.15
    assert type_boosts(detect("unit test coverage of integration suites"))["function"] == 1.2
    assert type_boosts(detect("please tell me some stories"))["function"] == 1.1


def test_term_queries():
    assert parse_terms("foo Bar").must == ("foo", "bar")
    q = parse_terms('alpha OR beta NOT gamma pre* "two words"')
    assert q.any_of == (("alpha", "beta"),) and q.never == ("gamma",) and q.prefixes == ("pre",) and q.phrases == (("two", "words"),)
    assert parse_terms("NEAR(a b, 3)").near == (("a", "b", 3),)


def test_globs():
    import re

    m = lambda p, s: bool(re.match(globs.to_regex(p), s))
    assert m("**/*.ts", "a.ts") and m("**/*.ts", "x/y/a.ts") and not m("*.ts", "x/a.ts")
    assert m("src/**", "src/a/b") and not m("src/**", "srcx/a")
    assert m("a?c", "abc") and not m("a?c", "a/c")
    assert m("*.{js,ts}", "x.ts") and m("[!a]b", "cb") and not m("[!a]b", "ab")
    assert m("**/.env", ".env") and m("*", ".dot")
    assert globs.problem("") and globs.problem("[a") and globs.problem("{a") and globs.problem("*" + "a*" * 10)
    assert globs.problem("a\\[b") is None
    assert globs.to_like("a*b?_%") == "a%b_\\_\\%"
    assert globs.literal_prefix("src/a*") == "src/a"


def test_gitignore_last_rule_wins():
    import re

    rules = globs.gitignore_rules(["*.log", "!keep.log", "build/", "/top"])

    def ignored(p):
        out = False
        for ignores, rx in rules:
            out = ignores if re.match(rx, p) else out
        return out

    assert ignored("a.log") and ignored("x/a.log") and not ignored("keep.log")
    assert ignored("build/x") and ignored("a/build/x") and not ignored("build")
    assert ignored("top") and not ignored("a/top")


def test_tables_of_queries_agree_with_single_ones(spark):
    from textloom.functions.query import half_up
    from textloom.operators import queries

    asked = ["auth token", "  Fix the API bug ", "", "zzz", "handle database error in async test", "UserService", "verify token", "get user_id from-db"]
    df = spark.createDataFrame([(q,) for q in asked], "query string")
    got = {r["query"]: r for r in queries.expanded(df).collect()}
    for q in asked:
        x = expand(q)
        assert (got[q].expanded, tuple(got[q].terms)) == (x.expanded, x.terms)
    rows = sorted(tuple(r) for r in queries.intents(df).collect())
    assert rows == sorted((q, k + 1, m.category, m.confidence) for q in asked for k, m in enumerate(detect(q).matches))
    assert half_up(0.125) == 0.13
