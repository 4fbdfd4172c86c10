"""Steps whose disk, memory or time grew faster than their input, and searches that lost rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.nearest import Nearest
from textloom.llm import ann
from textloom.operators import chunking, fts, vector
from textloom.plans.engine import Config, Engine


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def shuffled(spark) -> int:
    """Bytes written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_a_stored_index_moves_no_postings(spark, tmp_path):
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.concat(F.lit("w"), (F.col("n") * k % 97).cast("string"))), " ")
    docs = spark.range(400).toDF("n").select(F.sha2(F.col("n").cast("string"), 256).alias("id"), text.alias("text"))
    docs = docs.union(spark.createDataFrame([("a", "la para"), ("a", "w1 para"), ("a", "la la para"), ("e", ""), ("n", None)], "id string, text string")).coalesce(3)
    index, path, before = fts.Index.of(docs), f"file://{tmp_path}/fts", shuffled(spark)
    index.write(path)
    assert shuffled(spark) == before
    back = fts.Index.read(spark, path)
    assert spark.read.parquet(f"{path}/entries").where("id is not null").count() == docs.count()  # an id is stored once, not with every term
    assert rows(back.postings) == rows(index.postings) and rows(back.totals) == rows(index.totals)  # a repeated id too
    for query in ("la para", "w1 OR w2", "w5 NOT w10", "w9*"):
        assert rows(fts.search(docs, query, 50, index=back)) == rows(fts.search(docs, query, 50, index=index))
    scan = back.hits(["la"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,la)" in scan  # the files are asked for the term
    again = f"file://{tmp_path}/again"
    back.remove(docs.where("id = 'a'").select("id")).write(again)
    assert rows(fts.Index.read(spark, again).postings) == rows(index.postings.where("id <> 'a'"))


def _vectors(kind: str, rng) -> np.ndarray:
    """Vectors whose codes tell little about the nearest."""
    x = rng.normal(size=(3_000, 8))
    if kind == "tight":  # copies of a few vectors with little noise: hundreds share a code
        x = x[rng.integers(0, 4, 3_000)] + 1e-3 * x
    if kind == "offset":  # all point almost the same way
        x = 100 + x
    if kind == "scaled":  # rows of one direction differ in length alone
        x = x[rng.integers(0, 40, 3_000)] * rng.uniform(0.1, 9, (3_000, 1))
    return x.astype(np.float32).astype(np.float64)


@pytest.mark.parametrize("kind", ["tight", "offset", "scaled", "plain"])
def test_search_loses_no_nearest_row(spark, kind, monkeypatch):
    x = _vectors(kind, np.random.default_rng(3))
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(ann, "STRIPE_BYTES", 80_000)
    got: dict = {}
    for r in ann.search(v, rerank=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3_000, 50))
    for q, found in got.items():
        s = ann.cosine(np.repeat(x[q][None], len(x), 0), x)
        s[q] = -2
        want = np.lexsort((np.arange(len(x)), -s))[:5]
        assert sorted(found) == [(k + 1, i, s[i]) for k, i in enumerate(want.tolist())]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_a_batch_of_queries_agrees_with_each_alone(spark, metric):
    rng = np.random.default_rng(4)
    x = 1.01 * np.round(rng.normal(size=(700, 5)), 1)  # ties
    x[7], x[8] = 0, np.nan
    data = [(f"r{k:03d}", e.tolist()) for k, e in enumerate(x)] + [("short", [2.0]), ("null", None), ("gap", [None, 1.0, 1.0, 1.0, 1.0])]
    v = spark.createDataFrame(data, "id string, vector array<float>").repartition(3).cache()
    asked = v.where("id IN ('r000', 'r003', 'r007', 'short', 'null')").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = vector.top_k_batch(v, asked, 4, metric).collect()
    for q in asked.where("query_id <> 'null'").collect():
        fit = v.where("vector is not null and not exists(vector, x -> x is null)")
        want = [(r.id, r.distance, r.score) for r in vector.top_k(fit, q.query, 4, metric).collect()]
        assert [(r.id, r.distance, r.score) for r in sorted((r for r in got if r.query_id == q.query_id), key=lambda r: r["rank"])] == want


def test_a_batch_of_queries_takes_no_row_per_pair(spark):
    v = spark.range(3_000).select("id", F.array(*[(F.col("id") * k % 101).cast("float") for k in range(1, 9)]).alias("vector"))
    plan = vector.top_k_batch(v, v.where("id % 10 = 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan and "Generate" not in plan


def test_nearest_by_blocks(monkeypatch):
    monkeypatch.setattr("textloom.functions.nearest.PAIRS", 5_000)
    monkeypatch.setattr("textloom.functions.nearest.EXACT", 300)
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.integers(0, 3, (900, 3)), rng.normal(size=(300, 3)) * 1e3)).astype(float)
    ids = rng.permutation(len(x))
    q, near = x[::40], Nearest(x[::40], 7)
    for a in range(0, len(x), 110):
        near.add(ids[a : a + 110], x[a : a + 110])
    of, got, far = near.found()
    for j, y in enumerate(q):
        d = ((x - y)[:, 0] ** 2 + (x - y)[:, 1] ** 2) + (x - y)[:, 2] ** 2
        want = np.lexsort((ids, d))[:7]
        assert got[of == j].tolist() == ids[want].tolist() and far[of == j].tolist() == d[want].tolist()


@pytest.mark.parametrize("step", [chunking.comment_rows, chunking.summarized, lambda f: chunking.chunked(f, "code-aware")])
def test_files_reach_python_in_bounded_batches(spark, step):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    files = spark.createDataFrame([("a.py", 'def f(x):\n    """Says what it does, at length."""\n    return x\n'), ("b.py", None), ("c.js", "/** Adds one to a given number. */\nfunction g(x) {}\n"), ("d.md", "words")], "path string, text string")
    found = rows(step(files), "path")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    assert len(found) >= 2
    if step is chunking.comment_rows:
        assert rows(step(files), "path", "start_line", "end_line", "chunk_name", "chunk_type") == [("[code-comment] a.py", 2, 2, "f", "docstring"), ("[code-comment] c.js", 1, 1, "g", "doc")]


def test_an_engine_moves_no_postings(spark, tmp_path):
    text = F.concat(F.lit("def f(x):\n    return "), F.repeat(F.concat(F.lit("word"), F.col("n").cast("string"), F.lit(" + ")), 20), F.lit("1\n"))
    files = spark.range(60).toDF("n").select(F.concat(F.lit("f"), F.col("n").cast("string"), F.lit(".py")).alias("path"), text.alias("text")).withColumn("content_hash", F.sha2("text", 256))
    engine = Engine(spark, f"file://{tmp_path}/engine", Config(extract_comments=False))
    engine.build(files)
    before = shuffled(spark)
    engine._postings()
    assert shuffled(spark) == before
    assert rows(engine.search("word7", mode="fts"), "path") == [("f7.py",)]
