import pytest
from pyspark.sql import functions as F

from textloom.functions.text import trimmed_lines
from textloom.operators import chunking, evaluation, fts, fusion, paths, policy, ranking, results, state, vector


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])], "id long, vector array<float>")
    got = vector.top_k(v, [0.0, 0.0], 5)
    assert [(r.id, r.distance, r.score) for r in got.collect()] == [(1, 0.0, 1.0), (2, 1.0, 0.5), (3, 1.0, 0.5)]
    assert vector.top_k(v, [0.0, 0.0], 0).count() == 1
    assert [r.id for r in vector.top_k(v, [2.0, 0.0], 2, "dot").collect()] == [2, 1]
    assert vector.top_k(v, [1.0, 1.0], 3, "cosine").first().id == 2
    with pytest.raises(ValueError):
        vector.check_dimension(v, [1.0, 2.0, 3.0])
    asked = v.where("id in (2, 3)").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    assert rows(vector.top_k_batch(v, asked, 1), "query_id", "id") == [(2, 2), (3, 3)]
    with pytest.raises(ValueError):
        vector.top_k_batch(v, asked, 1, most_queries=1)
    assert vector.index_shape(10_000, 64) == (100, 4)


def test_top_k_is_planned_without_a_full_sort(spark):
    v = spark.range(10).select("id", F.array(F.col("id").cast("float")).alias("vector"))
    plan = vector.top_k(v, [1.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_ivf_recall(spark):
    import random

    r = random.Random(3)
    data = [(k, [r.gauss(k % 8, 0.3) for _ in range(8)]) for k in range(400)]
    v = spark.createDataFrame(data, "id long, vector array<float>")
    index = vector.InvertedFile.build(v, partitions=8)
    q = data[5][1]
    want = {x.id for x in vector.top_k(v, q, 10).collect()}
    assert len(want & {x.id for x in index.search(q, 10, probes=3).collect()}) >= 9
    assert vector.InvertedFile.build(v) is None


def docs(spark):
    return spark.createDataFrame([(1, "the quick brown fox"), (2, "quick quick dog"), (3, "lazy dog sleeps"), (4, None), (5, "")], "id long, text string")


def test_keyword_search(spark):
    d = docs(spark)
    assert [r.id for r in fts.search(d, "quick", 10).collect()] == [2, 1]
    assert [r.id for r in fts.search(d, "quick dog", 10).collect()] == [2]
    assert {r.id for r in fts.search(d, "fox OR lazy", 10).collect()} == {1, 3}
    assert [r.id for r in fts.search(d, "dog NOT quick", 10).collect()] == [3]
    assert rows(fts.matching(fts.Index.of(d), "sle*")) == [(3,)]
    assert rows(fts.matching(fts.Index.of(d), '"brown fox"', d)) == [(1,)]
    assert rows(fts.matching(fts.Index.of(d), "NEAR(the fox, 2)", d)) == [(1,)]
    assert rows(fts.matching(fts.Index.of(d), "NEAR(the fox, 1)", d)) == []
    assert fts.search(d, "  ", 10).count() == 0
    assert {r.id for r in fts.search(d, "quick dog", 10, "tfidf").collect()} == {1, 2, 3}
    assert rows(fts.substring_search(d, "QUICK"), "id") == [(1,), (2,)]
    assert fts.scorer_for(6000) == "bm25" and fts.scorer_for(10) == "tfidf" and fts.scorer_for(10, "native") == "bm25"


def test_index_round_trip_and_removal(spark, tmp_path):
    i = fts.Index.of(docs(spark))
    i.write(f"file://{tmp_path}/fts")
    back = fts.Index.read(spark, f"file://{tmp_path}/fts")
    assert rows(fts.bm25_scores(back, "quick"), "id") == [("1",), ("2",)]  # ids are strings on disk
    assert rows(fts.bm25_scores(i, "quick"), "id") == [(1,), (2,)]
    left = i.remove(spark.createDataFrame([(2,)], "id long"))
    assert rows(fts.tfidf_scores(left, "quick"), "id") == [(1,)]


def test_upsert_keeps_the_latest(spark):
    d = docs(spark).where("id < 3")
    changes = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, None, 3), (9, "nine", 1)], "id long, text string, seq long")
    assert rows(fts.upsert(d, changes)) == [(1, "new"), (9, "nine")]


def test_minmax(spark):
    s = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 3.0)], "id long, score double")
    assert rows(fts.minmax(s)) == [(1, 0.0), (2, 1.0), (3, 0.5)]
    assert rows(fts.minmax(s, negate=True)) == [(1, 1.0), (2, 0.0), (3, 0.5)]
    assert rows(fts.minmax(s.where("id = 1"))) == [(1, 1.0)]
    assert rows(fts.minmax(s.limit(0))) == []


def test_rrf_and_fusion(spark):
    one = spark.range(1).select(fusion.rrf(F.lit(1), F.lit(None).cast("int"), 0.5).alias("a"), fusion.rrf(F.lit(1), F.lit(2), 0.7).alias("b")).first()
    assert abs(one.a - 0.5 / 61) < 1e-12 and abs(one.b - (0.7 / 61 + 0.3 / 62)) < 1e-12
    v = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    f = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = fusion.fuse(v, f, 10).collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[0].score == 1.0
    assert [r.id for r in fusion.fuse(v, f, 10, literal_ids=True).collect()] == ["a", "b", "b", "c"]
    assert fusion.fuse(v, f, 10, alpha=1.0).where("id = 'c'").first().score == 0.0
    assert fusion.mode_of("x") == "hybrid" and fusion.alpha_of(3) == 1.0 and fusion.alpha_of(None) == 0.5


def test_ranking(spark):
    r = spark.createDataFrame(
        [("1", 0.5, "x", "src/user/auth.ts", "function", "UserAuth", None, "doc"), ("2", 0.5, "y" * 5000, "a.ts", "module", None, ["auth"], " "), ("3", 0.4, None, None, None, "user auth", None, None)],
        "id string, score double, text string, path string, chunk_type string, chunk_name string, chunk_tags array<string>, chunk_docstring string",
    )
    got = {x.id: x for x in ranking.rank(r, "user auth").collect()}
    assert got["1"].name_boost == 1.3 and got["1"].type_boost == 1.1 and abs(got["1"].path_boost - 1.1) < 1e-12 and got["1"].docstring_bonus == 1.05
    assert got["2"].length_penalty == 0.95 and got["2"].tag_boost == 1.1 and got["2"].docstring_bonus == 1.0 and got["2"].name_boost == 1.0
    assert got["3"].name_boost == 1.4 and got["3"].type_boost == 1.0 and got["3"].path_boost == 1.0
    off = ranking.rank(r, "user auth", ranking.Config(enabled=False))
    assert {x.final_score for x in off.collect()} == {0.5, 0.4}
    flat = ranking.rank(r, "user auth", ranking.Config(weights=ranking.Weights(0, 0, 0, 0, 0, 0)))
    assert {x.final_score for x in flat.collect()} == {0.5, 0.4}
    s = ranking.statistics(ranking.rank(r, "user auth")).first()
    assert s.max_name_boost == 1.4 and s.reordered >= 0
    assert ranking.intent_boosted(r, "zzz qqq").count() == 3
    assert ranking.intent_boosted(r, "login auth").where("id = '2'").first().score > 0.5 * 0.9


def test_trim_and_merge(spark):
    t = spark.createDataFrame([("\n  \n a\n\nb\n \n",), ("x",), ("",), (None,)], "t string").select(trimmed_lines("t").alias("t"))
    assert [r.t for r in t.collect()] == [" a\n\nb", "x", "", None]
    r = spark.createDataFrame(
        [("f", 1, 1, 3, 0.2, "l1\nl2\nl3"), ("f", 2, 3, 5, 0.9, "l3\nl4\nl5"), ("f", 3, 6, 6, 0.1, "l6"), ("f", 4, 9, 9, 0.5, "l9"), ("f", 5, 2, 2, 0.3, "l2"), ("g", 6, 1, 1, 0.4, "g1")],
        "path string, id long, start_line int, end_line int, score double, text string",
    )
    got = [(x.path, x.start_line, x.end_line, x.score, x.text, x.parts) for x in results.merged(r).collect()]
    assert got == [("f", 1, 6, 0.9, "l1\nl2\nl3\nl4\nl5\nl6", 4), ("f", 9, 9, 0.5, "l9", 1), ("g", 1, 1, 0.4, "g1", 1)]
    assert results.compact(r).first().asDict() == {"l": "f:1-3", "t": "l1\nl2\nl3", "s": 0.2}
    again = results.merged(r.repartition(3))
    assert rows(again, "path", "start_line", "text") == rows(results.merged(r), "path", "start_line", "text")


def test_deltas(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    b = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4"), ("e", None)], "path string, hash string")
    assert rows(state.fingerprint_delta(a, b), "path", "status") == [("a", "removed"), ("b", "unchanged"), ("c", "modified"), ("d", "added"), ("e", "unreadable")]
    assert rows(state.fingerprint_delta(a, a), "status") == [("unchanged",)] * 3
    d = state.fingerprint_delta(a, b).where("status <> 'unreadable'")
    new = b.join(d.where("status in ('added', 'modified')"), "path", "left_semi")
    once = state.apply_delta(a, d, new)
    assert rows(once) == rows(b.where("hash is not null")) == rows(state.apply_delta(once, d, new))


def test_chunk_diff_is_a_multiset(spark):
    s = "path string, id string, text string, start_line int, end_line int"
    old = spark.createDataFrame([("f", "1", "x", 1, 1), ("f", "2", "x", 2, 2), ("f", "3", "y", 3, 3)], s)
    new = spark.createDataFrame([("f", None, " x ", 1, 1), ("f", None, "z", 2, 2), ("f", None, "y", 4, 4)], s)
    diff = state.chunk_diff(old, new)
    assert rows(diff.groupBy("status").count()) == [("added", 1), ("moved", 1), ("removed", 1), ("unchanged", 1)]
    one = state.diff_summary(diff).first()
    assert one.saved == 2 and one.beneficial and one.worthwhile
    moved = state.updated_spans(old, diff)
    assert rows(moved.where("id = '3'"), "start_line") == [(4,)]


def test_merkle(spark):
    c = spark.createDataFrame([("d/f", "a", 1, 1), ("d/f", "b", 2, 2), ("g", "a", 1, 1)], "path string, text string, start_line int, end_line int")
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    chunks = state.merkle_chunks(c)
    files = state.merkle_files(chunks.repartition(3))
    want = h(h("1:1:a") + ":" + h("2:2:b"))
    assert dict((r.path, r.hash) for r in files.collect())["d/f"] == want
    dirs = state.merkle_directories(files)
    assert dict((r.directory, r.hash) for r in dirs.collect())["d"] == h(f"f:{want}")
    by = {r.path: r.hash for r in files.collect()}
    assert state.merkle_root(files).first()["hash"] == h(f"d/f:{by['d/f']}|g:{by['g']}") and state.same_root(state.merkle_root(files), state.merkle_root(files.repartition(3)))
    assert rows(state.duplicate_chunks(chunks), "copies", "files") == [(2, 2)]
    assert state.merkle_diff(files, files).count() == 0


def test_dirty_set(spark):
    e = spark.createDataFrame([("a", "add", 1), ("a", "unlink", 2), ("b", "unlink", 1), ("b", "change", 2)], "path string, op string, seq long")
    d = state.dirty_set(e)
    assert rows(d) == [("a", "delete"), ("b", "upsert")]
    assert rows(state.dirty_strings(d)) == [("__deleted__:a",), ("b",)]


def test_policy(spark):
    f = spark.createDataFrame([("node_modules/a.js", 1, b"x"), ("a/.env", 1, b"x"), (".env", 1, b"x"), ("x.png", 1, b"x"), ("big.ts", 1 << 21, b"x"), ("data.zzz", 3, b"a\x00b"), ("ok.zzz", 3, b"abc"), ("logs/a.txt", 1, b""), ("deny.txt", 1, b"")], "path string, length long, content binary")
    p = policy.Policy(exclude=("deny.*",), gitignore=(("", ("logs/",)),))
    got = {r.path: r.category for r in policy.classify(f, p, content="content").collect()}
    assert got == {"node_modules/a.js": "hardcoded", "a/.env": None, ".env": "hardcoded", "x.png": "binary", "big.ts": "size", "data.zzz": "binary", "ok.zzz": None, "logs/a.txt": "gitignore", "deny.txt": "user-exclude"}
    assert policy.parse_size("500kb") == 512_000
    with pytest.raises(ValueError):
        policy.parse_size("1GB")


def test_paths(spark):
    f = spark.createDataFrame([("src/a.ts",), ("src/b/c.ts",), ("src/a.ts",), ("x.py",)], "path string")
    assert [(r.path, r.total_matches) for r in paths.by_glob(f, "src/**/*.ts", 1).collect()] == [("src/a.ts", 2)]
    with pytest.raises(ValueError):
        paths.by_glob(f, "[")
    assert rows(paths.by_like(f, "*.ts")) == [("src/a.ts",), ("src/b/c.ts",)]
    for p in ("a/Makefile", "x.PY", "Dockerfile", "none", "a.unknown", "y.tsx"):
        assert spark.range(1).select(paths.language(F.lit(p)).alias("l")).first().l == paths.language_of(p)
    bad = spark.createDataFrame([("../x",), ("/abs",), ("a/../b",), ("ok/..x",)], "path string").where(paths.safe("path"))
    assert rows(bad) == [("ok/..x",)]


def test_evaluation(spark):
    r = spark.createDataFrame([(1, 1, "src/Auth.ts"), (1, 2, "x"), (2, 1, "y")], "query_id long, rank int, path string")
    e = spark.createDataFrame([(1, "auth"), (1, "nope"), (2, "z"), (3, "q")], "query_id long, wanted string")
    assert rows(evaluation.rated(evaluation.precision_at(r, e, 2))) == [(1, 0.5, 1, "MEDIUM"), (2, 0.0, 0, "LOW"), (3, 0.0, 0, "LOW")]
    s = evaluation.summaries(spark.createDataFrame([("a", 1.0), ("b", 0.5)], "config string, precision double"))
    assert evaluation.best(s).first().config == "a" and evaluation.compare(s, "a", "b").first().difference == 0.5


def test_chunk_tables(spark):
    f = spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.md", "# T\n\nbody"), ("c.txt", None), ("d.txt", "")], "path string, text string")
    c = chunking.chunked(f, "ast")
    assert rows(c.where("path = 'a.py'"), "chunk_type", "chunk_name", "chunk_language") == [("function", "f", "python")]
    assert c.where("path in ('c.txt', 'd.txt')").count() == 0
    assert rows(c, "id") == rows(chunking.chunked(f.repartition(2), "ast"), "id")
    assert chunking.summarized(f).where("path = 'a.py'").first().functions[0].name == "f"
    assert rows(chunking.line_chunks(f, 1).where("path = 'a.py'"), "start_line", "text") == [(1, "def f():"), (2, "    return 1"), (3, "")]
    assert rows(chunking.line_counts(f).where("path = 'a.py'"), "total", "blank", "code") == [(3, 1, 2)]
