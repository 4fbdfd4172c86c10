"""Stored vector indexes, blocks of queries, runs of gitignore rules, failed builds."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import policy, vector
from textloom.plans.engine import Config, Engine
from textloom.streaming import events


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_stored_cells(spark, tmp_path):
    data = [(k, [float(k % 8), float(k)], "text") for k in range(200)] + [(900, None, "x"), (901, [1.0], "x"), (902, [], "x")]
    v = spark.createDataFrame(data, "id long, vector array<float>, note string").repartition(3)
    path = f"file://{tmp_path}/ivf"
    vector.InvertedFile.build(v, partitions=4).write(path, version="1")
    back = vector.InvertedFile.read(spark, path)
    assert back.cells.count() == 200 and back.notes == {"version": "1"}
    assert back.info() | {"chunk_count": 0} == {"has_index": True, "index_type": "ivf", "distance_type": "l2", "chunk_count": 0, "num_partitions": len(back.centroids)}
    q = [3.0, 50.0]
    assert rows(back.search(q, 7, probes=4), "id", "distance") == rows(vector.top_k(v, q, 7), "id", "distance")
    plan = back.search(q, 7, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ivf_id" in plan.split("PartitionFilters")[1].split("]")[0]
    assert vector.InvertedFile.build(v.limit(0), partitions=4) is None


def test_blocks_of_queries_agree(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k), float(k * k % 17)]) for k in range(60)], "id long, vector array<float>")
    asked = v.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    one = rows(vector.top_k_batch(v, asked, 3))
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 64)  # four vectors
    assert rows(vector.top_k_batch(v, asked, 3)) == one and len(one) == 36
    assert vector.top_k_batch(v, asked.limit(0), 3).count() == 0


def test_many_gitignore_rules_are_few_branches(spark):
    lines = tuple(f"name{k}.txt" for k in range(2_000)) + ("!name7.txt", "!name8.txt", "name8.txt")
    p = policy.Policy(gitignore=(("", lines),))
    d = spark.createDataFrame([(f"a/name{k}.txt",) for k in (6, 7, 8, 2_001)], "path string")
    assert rows(d.select("path", policy.ignored(F.col("path"), p))) == [("a/name2001.txt", False), ("a/name6.txt", True), ("a/name7.txt", False), ("a/name8.txt", True)]
    assert policy.ignored(F.col("path"), p)._jc.toString().count("WHEN") <= 3


def test_latest_replays_one_event_a_path(spark):
    e = spark.createDataFrame([("a", 1, "add"), ("a", 3, "unlink"), ("b", 2, "add"), ("a", 2, "change")], "path string, seq long, op string")
    assert rows(events.latest(e)) == [("a", 3, "unlink"), ("b", 2, "add")]


def files(spark, data):
    return spark.createDataFrame(data, "path string, text string").withColumn("content_hash", F.sha2("text", 256))


def test_engine_uses_its_vector_index_until_the_corpus_changes(spark, tmp_path):
    embed = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    e = Engine(spark, f"file://{tmp_path}/v", Config(extract_comments=False), embedder=embed, embed_query=lambda q: [float(len(q)), 1.0], model="length")
    old = files(spark, [(f"f{k}.py", "x" * (k + 1)) for k in range(20)])
    e.build(old)
    assert e.vector_index() == {"has_index": False, "index_type": "none", "chunk_count": 20}
    assert e.index_vectors()["has_index"] is False  # below ten thousand chunks
    assert e.index_vectors(partitions=3)["num_partitions"] == 3
    assert e.search("x" * 9, 1, mode="vector").first().path == "f8.py"
    e.apply(old.where("path <> 'f8.py'"))
    assert e.vector_index()["has_index"] is False
    assert e.search("x" * 9, 1, mode="vector").first().path in ("f7.py", "f9.py")  # equally near
    e.embed_query = lambda q: [1.0]
    with pytest.raises(ValueError):
        e.search("x", 1, mode="vector")


def test_a_failed_build_says_so(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/f", Config(extract_comments=False))
    bad = files(spark, [("a.py", "x")]).withColumn("text", F.raise_error(F.lit("unreadable")).cast("string"))
    with pytest.raises(Exception, match="unreadable"):
        e.build(bad)
    assert e.status().first().status == "failed"
