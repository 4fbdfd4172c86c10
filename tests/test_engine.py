import datetime as dt

import pytest
from pyspark.sql import functions as F

from textloom.operators import policy
from textloom.plans.engine import Config, Engine
from textloom.sources import files as sources
from textloom.streaming import events as stream


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for path, text in {
        "src/auth.py": 'def login(user):\n    """Log a user in with a password."""\n    return user\n',
        "src/db.py": "def query(sql):\n    return sql\n",
        "docs/guide.md": "# Guide\n\nHow to login with a password.\n",
        "node_modules/x.js": "no",
        "img.png": "no",
        ".gitignore": "*.tmp\n",
        "a.tmp": "no",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_scan(spark, tree):
    rules = sources.gitignores(spark, f"file://{tree}")
    found = sources.scan(spark, f"file://{tree}", policy.Policy(gitignore=rules))
    assert sorted(r.path for r in found.collect()) == [".gitignore", "docs/guide.md", "src/auth.py", "src/db.py"]
    counts = {r.category: r.files for r in sources.report(spark, f"file://{tree}", policy.Policy(gitignore=rules)).collect()}
    assert counts == {None: 4, "binary": 1, "gitignore": 1}  # node_modules is never entered
    with pytest.raises(ValueError):
        sources.scan(spark, f"file://{tree}", policy.Policy(), max_files=1)


def test_engine(spark, tree, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/index", Config(chunking_strategy="ast"))
    assert e.status().first().status == "not_found"
    files = e.scan(f"file://{tree}")
    assert e.build(files).first().status == "ready"
    assert [r.path for r in e.search("login").collect()] == ["src/auth.py"]
    found = {r.path for r in e.search_docs("password").collect()}
    assert found == {"docs/guide.md", "[code-comment] src/auth.py"}
    assert e.search("login", compact=True).columns == ["l", "t", "s"]
    assert [r.path for r in e.paths("src/*.py").collect()] == ["src/auth.py", "src/db.py"]
    for bad in ({"query": ""}, {"query": "x", "top_k": 51}):
        with pytest.raises(ValueError):
            e.search(**bad)
    new = files.where("path <> 'src/db.py'").withColumn("text", F.when(F.col("path") == "src/auth.py", "def signin():\n    pass\n").otherwise(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))
    counts = {r.status: r.files for r in e.apply(new).collect()}
    assert counts == {"unchanged": 2, "modified": 1, "removed": 1}
    assert e.search("login").count() == 0 and e.search("signin").first().path == "src/auth.py"
    assert [r.path for r in e.search_docs("user password").collect()] == ["docs/guide.md"]
    assert {r.status: r.files for r in e.drift(new).collect()} == {"unchanged": 3}
    changes = spark.createDataFrame([("docs/guide.md", "delete"), ("src/db.py", "upsert")], "path string, op string")
    e.apply_changes(changes, lambda paths: files.join(paths, "path", "left_semi"))
    assert e.search("sql").first().path == "src/db.py" and e.search_docs("guide").count() == 0
    assert {r.status: r.files for r in e.drift(new).collect()} == {"unchanged": 2, "removed": 1, "added": 1}
    e.reindex_file(files, "src/auth.py")
    assert e.search("login").first().path == "src/auth.py"
    e.reindex_file(new, "src/auth.py")
    assert e.code.of_path("src/auth.py").count() == 1 and e.code.delete_paths(["src/auth.py"]) == 1
    assert {r.path for r in e.code.read().collect()} == {".gitignore", "src/db.py"}
    with pytest.raises(ValueError):
        Config(max_file_size="1GB")


def test_vector_mode(spark, tree, tmp_path):
    embed = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    e = Engine(spark, f"file://{tmp_path}/v", embedder=embed, embed_query=lambda q: [float(len(q)), 1.0], model="length")
    e.build(e.scan(f"file://{tree}"))
    assert e.search("login", mode="hybrid").count() >= 2
    assert e.search("login", mode="vector").count() >= 2
    other = Engine(spark, f"file://{tmp_path}/v", model="another")
    with pytest.raises(ValueError):
        other.search("login")


def _events(spark):
    t = dt.datetime(2024, 1, 1)
    s = lambda ms: t + dt.timedelta(milliseconds=ms)
    data = [("a", "add", 1, s(0)), ("a", "change", 2, s(300)), ("a", "unlink", 3, s(2000)), ("b", "add", 4, s(100)), (".git/x", "change", 5, s(1)), ("z", "add", 6, s(60_000))]
    return spark.createDataFrame(data, "path string, op string, seq long, ts timestamp")


def test_stream_replay_equals_batch(spark, tmp_path):
    rows = _events(spark)
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    want = {(r.path, r.op, r.events) for r in stream.debounced(stream.allowed(rows), stream=False).collect()}
    q = stream.debounced(stream.allowed(stream.source(spark, f"file://{tmp_path}/in")), late="1 second").writeStream.format("memory").queryName("out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.path, r.op, r.events) for r in spark.sql("select * from out").collect()}
    assert got == {w for w in want if w[0] != "z"}  # the last one waits for the watermark
    assert want == {("a", "change", 2), ("a", "unlink", 1), ("b", "add", 1), ("z", "add", 1)}


def test_lazy_strategy(spark, tmp_path):
    _events(spark).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    seen = []
    run = lambda: stream.lazy(stream.source(spark, f"file://{tmp_path}/in"), lambda df: seen.append({(r.path, r.op) for r in df.collect()}), f"file://{tmp_path}/cp")
    run().awaitTermination()
    assert seen == [{("a", "delete"), ("b", "upsert"), ("z", "upsert")}]
    run().awaitTermination()
    assert len(seen) == 1


def test_switch():
    class Q:
        isActive = True
        stopped = False

        def processAllAvailable(self):
            pass

        def stop(self):
            self.stopped, self.isActive = True, False

    s, q = stream.Strategies(), Q()
    assert s.switch("lazy", lambda: q) and not s.switch("lazy", lambda: None) and s.switch("git", Q) and q.stopped


def test_a_change_rewrites_the_buckets_it_touches_alone(spark, tmp_path):
    import os

    from textloom.sources.store import ChunkStore

    root = f"{tmp_path}/s"
    store = ChunkStore(spark, f"file://{root}", buckets=8)
    schema = "id string, path string, text string, vector array<double>"
    store.write(spark.createDataFrame([(f"i{k}", f"p{k}", f"text {k}", [float(k)]) for k in range(40)], schema))
    before = store.folders()
    new = spark.createDataFrame([("n", "p3", "new text", [9.0])], schema)
    store.replace_paths(spark.createDataFrame([("p3",)], "path string"), new)
    after = store.folders()
    moved = [b for b in after if after[b] != before[b]]
    assert len(moved) == 1 and store.of_path("p3").first().text == "new text" and store.read().count() == 40
    assert {r.id: list(r.vector) for r in store.read().where("path <> 'p3'").collect()} == {f"i{k}": [float(k)] for k in range(40) if k != 3}
    assert os.path.isdir(f"{root}/{before[moved[0]]}")  # for readers of the version before
    store.append(spark.createDataFrame([("a", "another", "x", None)], schema))
    assert not os.path.isdir(f"{root}/{before[moved[0]]}") and store.read().count() == 41
    assert store.delete_paths(["another", "p5"]) == 2 and store.delete_paths(["nowhere"]) == 0 and store.read().count() == 39
    store.delete_ids(spark.createDataFrame([(f"i{k}",) for k in range(40)] + [("n",)], "id string"))
    assert store.read().count() == 0 and store.read().columns == ["id", "path", "text", "vector"]
    assert [x for x in os.listdir(root) if x.startswith("current.json.")] == []


def test_prefix_search_and_dropping_all(spark, tmp_path):
    from textloom.operators import fts
    from textloom.plans.engine import Config, Engine

    docs = spark.createDataFrame([(1, "a thesis on these things"), (2, "nothing here"), (3, "thesaurus")], "id long, text string")
    plain = {(r.id, round(r.score, 9), r["rank"]) for r in fts.search(docs, "thes*").collect()}
    assert {x[0] for x in plain} == {1, 3} and plain == {(r.id, round(r.score, 9), r["rank"]) for r in fts.search(docs, "thes*", index=fts.Index.of(docs)).collect()}
    for q in ("thesis OR thesaurus", "these NOT nothing", '"these things"', "NEAR(thesis things, 3)", "nothing here", ""):
        for scorer in ("bm25", "tfidf"):
            a, b = (sorted((r.id, round(r.score, 9)) for r in fts.search(docs, q, scorer=scorer, index=i).collect()) for i in (None, fts.Index.of(docs)))
            assert a == b, (q, scorer)
    engine = Engine(spark, f"file://{tmp_path}/e", Config())
    engine.build(spark.createDataFrame([("a.py", "x = 1\n", "h")], "path string, text string, content_hash string"))
    assert engine.status().first().status == "ready"
    engine.drop()
    assert engine.status().first().status == "not_found"
