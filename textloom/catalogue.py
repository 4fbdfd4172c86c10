"""Every query of the engine by name, over the test tables, with its SQL for DuckDB.

A document is a file at ``<source>/<doc_id>.<lang>``; documents and embeddings meet by
id; the second snapshot of the corpus is the first with fixed edits by doc_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import query
from .functions import text as T
from .operators import chunking, evaluation, fts, fusion, paths, policy, queries, ranking, results, state, vector
from .plans.engine import Config, Engine
from .sources.store import ChunkStore, lookup, read_json, work_folder, write_json
from .streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return _t(spark, d, "documents").select("doc_id", path.alias("path"), "text", "lang")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _query_vector(spark: SparkSession, d: str, vec_id: int = 7) -> list[float]:
    return _vectors(spark, d).where(F.col("id") == vec_id).first()["vector"]


FILES_SQL = "files AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, text, lang FROM documents)"
DOT = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(e.embedding, q.v), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), lambda a, b: a + b)"
L2 = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(e.embedding, q.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), lambda a, b: a + b)"
NORMS = "(sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, b: a + b)) * sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(q.v, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, b: a + b)))"


def _topk_sql(distance: str) -> str:
    return f"""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7),
    d AS (SELECT vec_id AS id, {distance} AS d FROM embeddings e, q)
    SELECT id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM d ORDER BY d, id LIMIT 10"""


def _topk(spark: SparkSession, d: str, metric: str) -> DataFrame:
    found = vector.top_k(_vectors(spark, d), _query_vector(spark, d), 10, metric)
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register(_topk_sql(L2))
def vector_topk_l2(spark, d):
    return _topk(spark, d, "l2")


@register(_topk_sql(f"1.0 - {DOT} / {NORMS}"))
def vector_topk_cosine(spark, d):
    return _topk(spark, d, "cosine")


@register(_topk_sql(f"-({DOT})"))
def vector_topk_dot(spark, d):
    return _topk(spark, d, "dot")


@register(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 3),
    d AS (SELECT q.query_id, e.vec_id AS id, {L2} AS d FROM embeddings e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d)
    SELECT query_id, rank::INT AS rank, id, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def vector_topk_batch(spark, d):
    rows = _vectors(spark, d)
    asked = rows.where(F.col("id") % 100 == 3).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vector.top_k_batch(rows, asked, 5).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@register()
def ivf_search(spark, d):
    index = vector.InvertedFile.build(_vectors(spark, d), partitions=16)
    return index.search(_query_vector(spark, d), 10, probes=8).select("id", F.round("distance", 6).alias("distance"))


def _stored_cells(spark, d) -> vector.InvertedFile:
    path = work_folder(spark, "ivf")
    vector.InvertedFile.build(_vectors(spark, d), partitions=16).write(path)
    return vector.InvertedFile.read(spark, path)


@register(_topk_sql(L2))
def ivf_search_all_cells(spark, d):
    """The stored index read back; with every cell probed it is exact."""
    found = _stored_cells(spark, d).search(_query_vector(spark, d), 10, probes=16)
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register("SELECT count(*) AS chunks, 16 AS cells, count(*) AS assigned FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")
def ivf_info(spark, d):
    index = _stored_cells(spark, d)
    info = index.info()
    return index.cells.agg(F.lit(info["chunk_count"]).cast("long").alias("chunks"), F.lit(info["num_partitions"]).alias("cells"), F.count("*").alias("assigned"))


# keyword search

TERMS_SQL = """terms AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents),
    post AS (SELECT id, term, count(*) AS tf, len(ts) AS dl FROM (SELECT id, ts, unnest(ts) AS term FROM terms) GROUP BY id, term, len(ts)),
    tot AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM terms)"""


def _docs(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "rank")


_RANK_SQL = "SELECT id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, id))::INT AS rank FROM s ORDER BY score DESC, id LIMIT 10"
TFIDF_SQL = f"""WITH {TERMS_SQL}, df AS (SELECT term, count(*) AS df FROM post WHERE term IN ('la', 'para') GROUP BY term),
    s AS (SELECT id, list_sum(list(tf * (1 + ln(n / (1.0 + df))) ORDER BY term)) AS score FROM post JOIN df USING (term), tot GROUP BY id HAVING score > 0)
    {_RANK_SQL}"""


@register(TFIDF_SQL)
def tfidf_search(spark, d):
    return _ranked(fts.search(_docs(spark, d), "la para", 10, "tfidf"))


def _bm25_sql(words: list[str], where: str) -> str:
    quoted = ", ".join(f"'{w}'" for w in words)
    return f"""WITH {TERMS_SQL}, df AS (SELECT term, count(*) AS df FROM post WHERE term IN ({quoted}) GROUP BY term),
    ok AS ({where}),
    s AS (SELECT id, list_sum(list(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) ORDER BY term)) AS score
          FROM post JOIN df USING (term), tot WHERE id IN (SELECT id FROM ok) GROUP BY id)
    {_RANK_SQL}"""


@register(_bm25_sql(["para", "la"], "SELECT id FROM post WHERE term IN ('para', 'la') GROUP BY id HAVING count(*) = 2"))
def bm25_search(spark, d):
    return _ranked(fts.search(_docs(spark, d), "para la", 10))


@register(_bm25_sql(["pour", "auf"], "SELECT DISTINCT id FROM post WHERE term IN ('pour', 'auf')"))
def fts_or(spark, d):
    return _ranked(fts.search(_docs(spark, d), "pour OR auf", 10))


@register(_bm25_sql(["los"], "SELECT id FROM post WHERE term = 'los' AND id NOT IN (SELECT id FROM post WHERE term = 'para')"))
def fts_not(spark, d):
    return _ranked(fts.search(_docs(spark, d), "los NOT para", 10))


@register(f"WITH {TERMS_SQL} SELECT DISTINCT id FROM post WHERE starts_with(term, 'thes')")
def fts_prefix(spark, d):
    return fts.matching(fts.Index.of(_docs(spark, d)), "thes*")


@register(f"""WITH {TERMS_SQL}, h AS (SELECT id, dl, sum(tf) AS tf FROM post WHERE starts_with(term, 'thes') GROUP BY id, dl), df AS (SELECT count(*) AS df FROM h),
    s AS (SELECT id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h, df, tot)
    {_RANK_SQL}""")
def fts_prefix_search(spark, d):
    return _ranked(fts.search(_docs(spark, d), "thes*", 10))


@register("SELECT doc_id AS id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ', ' of the ')")
def fts_phrase(spark, d):
    docs = _docs(spark, d)
    return fts.matching(fts.Index.of(docs), '"of the"', docs)


@register(_bm25_sql(["para", "la"], "SELECT id FROM post WHERE term IN ('para', 'la') GROUP BY id HAVING count(*) = 2"))
def fts_stored_search(spark, d):
    """Postings written, read back and searched; ids are strings on disk."""
    docs, path = _docs(spark, d), work_folder(spark, "fts")
    fts.Index.of(docs.withColumn("id", F.format_string("%012d", "id"))).write(path)
    found = fts.search(docs, "para la", 10, index=fts.Index.read(spark, path))
    return found.select(F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"), "rank")


@register("""SELECT doc_id AS id, sha256(CASE WHEN doc_id % 4 = 0 THEN 'changed words ' || doc_id ELSE coalesce(text, '') END) AS hash FROM documents WHERE doc_id % 6 <> 0
    UNION ALL SELECT doc_id + 10000000 AS id, sha256('added') AS hash FROM documents WHERE doc_id % 50 = 0""")
def fts_upsert(spark, d):
    docs = _docs(spark, d)
    ids = docs.select("id")
    changes = ids.where("id % 4 = 0").select("id", F.concat(F.lit("changed words "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("seq"))
    changes = changes.unionByName(ids.where("id % 6 = 0").select("id", F.lit(None).cast("string").alias("text"), F.lit(2).alias("seq")))
    changes = changes.unionByName(ids.where("id % 50 = 0").select((F.col("id") + 10_000_000).alias("id"), F.lit("added").alias("text"), F.lit(1).alias("seq")))
    return fts.upsert(docs, changes).select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@register(f"WITH {TERMS_SQL} SELECT count(*) AS n, round(avg(len(ts)), 6) AS avgdl FROM terms WHERE id % 3 <> 0 AND len(ts) > 0")
def fts_remove(spark, d):
    docs = _docs(spark, d)
    left = fts.Index.of(docs).remove(docs.where("id % 3 = 0").select("id"))
    return left.totals.select("n", F.round("avgdl", 6).alias("avgdl"))


@register("SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'license') ORDER BY id LIMIT 50")
def fts_substring(spark, d):
    return fts.substring_search(_docs(spark, d), "License", 50)


@register(f"WITH {TERMS_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM post GROUP BY term")
def fts_document_frequencies(spark, d):
    return fts.Index.of(_docs(spark, d)).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@register("""WITH s AS (SELECT doc_id AS id, n_chars::DOUBLE AS score FROM documents), e AS (SELECT min(score) AS a, max(score) AS b FROM s)
    SELECT id, round(CASE WHEN a = b THEN (CASE WHEN b > 0 THEN 1 ELSE 0 END) ELSE (score - a) / (b - a) END, 6) AS score FROM s, e""")
def minmax_normalise(spark, d):
    s = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return fts.minmax(s).select("id", F.round("score", 6).alias("score"))


@register("""WITH s AS (SELECT doc_id AS id, -n_chars::DOUBLE AS score FROM documents), e AS (SELECT min(score) AS a, max(score) AS b FROM s)
    SELECT id, round(CASE WHEN a = b THEN 1 ELSE (score - a) / (b - a) END, 6) AS score FROM s, e""")
def minmax_negated(spark, d):
    s = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    return fts.minmax(s, negate=True).select("id", F.round("score", 6).alias("score"))


# fusion

_LISTS_SQL = f"""q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7),
    vd AS (SELECT vec_id AS id, {L2} AS d FROM embeddings e, q),
    vl AS (SELECT id, row_number() OVER (ORDER BY d, id) AS vr FROM vd QUALIFY vr <= 20),
    {TERMS_SQL}, df AS (SELECT term, count(*) AS df FROM post WHERE term IN ('para') GROUP BY term),
    fs AS (SELECT id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN df USING (term), tot),
    fl AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS fr FROM fs QUALIFY fr <= 20),
    f AS (SELECT coalesce(vl.id, fl.id) AS id, vr, fr, coalesce(0.5 / (60 + vr), 0) + coalesce(0.5 / (60 + fr), 0) AS raw FROM vl FULL JOIN fl ON vl.id = fl.id),
    t AS (SELECT * FROM f ORDER BY raw DESC, vr NULLS LAST, fr LIMIT 10)"""


def _hybrid(spark, d, k: int = 10) -> DataFrame:
    n = fusion.overfetch(k)
    v = fts.ranked(vector.top_k(_vectors(spark, d), _query_vector(spark, d), n).select("id", (-F.col("distance")).alias("score")), n)
    return fusion.fuse(v, fts.search(_docs(spark, d), "para", n), k)


@register(f"WITH {_LISTS_SQL} SELECT id, vr::INT AS vector_rank, fr::INT AS fts_rank, round(least(1.0, raw / (SELECT max(raw) FROM t)), 6) AS score FROM t")
def rrf_fuse(spark, d):
    return _hybrid(spark, d).select("id", "vector_rank", "fts_rank", F.round("score", 6).alias("score"))


@register(f"""WITH {_LISTS_SQL}, {FILES_SQL} SELECT id, path, round(least(1.0, raw / (SELECT max(raw) FROM t)), 6) AS score FROM t JOIN files ON doc_id = id""")
def hybrid_search(spark, d):
    found = _hybrid(spark, d)
    return _files(spark, d).join(found, F.col("doc_id") == F.col("id")).select("id", "path", F.round("score", 6).alias("score"))


# results

_SPANS_SQL = """spans AS (SELECT source AS path, doc_id AS id, (doc_id * 7 % 400 + 1)::INT AS start_line, (doc_id * 7 % 400 + 1 + n_chars % 12)::INT AS end_line, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents)"""


def _spans(spark, d):
    start = (F.col("doc_id") * 7 % 400 + 1).cast("int")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("n_chars") % 12).cast("int")), lambda i: F.concat(F.lit("line "), (F.col("doc_id") * 7 % 400 + 1 + i).cast("string"))), "\n")
    return _t(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("id"), start.alias("start_line"), (start + F.col("n_chars") % 12).cast("int").alias("end_line"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), lines.alias("text"))


@register(f"""WITH {_SPANS_SQL},
    m AS (SELECT *, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start_line, end_line, id) AS island FROM m),
    g AS (SELECT path, min(start_line) AS a, max(end_line) AS b, max(score) AS score, count(*) AS parts FROM i GROUP BY path, island)
    SELECT path, a AS start_line, b AS end_line, score, parts,
      array_to_string(list_transform(range(a, b + 1), lambda x: 'line ' || x), chr(10)) AS text FROM g""")
def merge_ranges(spark, d):
    return results.processed(_spans(spark, d)).drop("id")


@register(f"WITH {_SPANS_SQL} SELECT path || ':' || start_line || '-' || end_line AS l, floor(score * 100 + 0.5) / 100 AS s FROM spans")
def compact_output(spark, d):
    return results.compact(_spans(spark, d)).drop("t")


# state

_B_SQL = """a AS (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, sha256(text) AS hash FROM documents),
    b AS (SELECT CASE WHEN doc_id % 10 = 2 THEN path || '.new' ELSE path END AS path, CASE WHEN doc_id % 10 = 1 THEN sha256(text || ' edited') ELSE sha256(text) END AS hash
          FROM (SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, text FROM documents) WHERE doc_id % 10 <> 0)"""
_DELTA_SQL = f"""{_B_SQL}, delta AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'added' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'modified' END AS status
    FROM a FULL JOIN b ON a.path = b.path)"""


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    f = _files(spark, d)
    k = F.col("doc_id") % 10
    new = f.where(k != 0).select("doc_id", F.when(k == 2, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(k == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("text"))
    return f.select("doc_id", "path", "text"), new


def _prints(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("text", 256).alias("hash"))


@register(f"WITH {_DELTA_SQL} SELECT path, status FROM delta")
def fingerprint_delta(spark, d):
    a, b = _snapshots(spark, d)
    return state.fingerprint_delta(_prints(a), _prints(b)).select("path", "status")


@register(f"WITH {_DELTA_SQL} SELECT status, count(*) AS files FROM delta GROUP BY status")
def drift_summary(spark, d):
    a, b = _snapshots(spark, d)
    return state.drift(_prints(a), _prints(b))


@register(f"WITH {_DELTA_SQL}, kept AS (SELECT a.path, a.hash FROM a JOIN delta USING (path) WHERE status = 'unchanged') SELECT path, hash FROM kept UNION ALL SELECT b.path, b.hash FROM b JOIN delta USING (path) WHERE status IN ('added', 'modified')")
def apply_delta(spark, d):
    a, b = (_prints(x) for x in _snapshots(spark, d))
    delta = state.fingerprint_delta(a, b).select("path", "status")
    new = b.join(delta.where(F.col("status").isin("added", "modified")), "path", "left_semi")
    return state.apply_delta(a, delta, new)


_LINES = "SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n FROM documents"


def _line_rows(files: DataFrame) -> DataFrame:
    rows = files.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return rows.select("doc_id", "path", "text", (F.col("k") + 1).alias("start_line"), (F.col("k") + 1).alias("end_line"))


@register(f"""WITH l AS ({_LINES}), o AS (SELECT path, md5(text) AS h, n, row_number() OVER (PARTITION BY path, md5(text) ORDER BY n) AS r FROM l),
    w AS (SELECT path, md5(text) AS h, (CASE WHEN doc_id % 3 = 0 THEN n ELSE n + 1 END)::INT AS n, row_number() OVER (PARTITION BY path, md5(text) ORDER BY n) AS r FROM l WHERE NOT (doc_id % 3 = 1 AND n = 1)),
    j AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN w.n IS NULL THEN 'removed' WHEN o.n IS NULL THEN 'added' WHEN o.n = w.n THEN 'unchanged' ELSE 'moved' END AS status
          FROM o FULL JOIN w ON o.path = w.path AND o.h = w.h AND o.r = w.r)
    SELECT path, status, count(*) AS chunks FROM j GROUP BY path, status""")
def chunk_diff(spark, d):
    rows = _line_rows(_files(spark, d)).withColumn("chunk_hash", F.md5("text"))
    shift = F.when(F.col("doc_id") % 3 == 0, F.col("start_line")).otherwise(F.col("start_line") + 1)
    new = rows.where(~((F.col("doc_id") % 3 == 1) & (F.col("start_line") == 1))).withColumn("start_line", shift).withColumn("end_line", shift)
    old = rows.withColumn("id", F.concat_ws(":", "path", F.col("start_line").cast("string")))
    return state.chunk_diff(old, new).groupBy("path", "status").agg(F.count("*").alias("chunks"))


_MERKLE_SQL = f"""l AS ({_LINES}), c AS (SELECT path, n, sha256(n || ':' || n || ':' || text) AS h, sha256(text) AS content FROM l),
    f AS (SELECT path, sha256(string_agg(h, ':' ORDER BY n)) AS hash, count(*) AS chunks FROM c GROUP BY path),
    p AS (SELECT regexp_extract(path, '^(.*)/', 1) AS directory, regexp_extract(path, '([^/]*)$', 1) AS name, hash FROM f),
    dirs AS (SELECT directory, sha256(string_agg(name || ':' || hash, '|' ORDER BY name)) AS hash, count(*) AS files FROM p GROUP BY directory)"""


@register(f"WITH {_MERKLE_SQL} SELECT path, hash, chunks FROM f")
def merkle_files(spark, d):
    return state.merkle_files(state.merkle_chunks(_line_rows(_files(spark, d))))


@register(f"WITH {_MERKLE_SQL} SELECT directory, hash, files FROM dirs")
def merkle_directories(spark, d):
    return state.merkle_directories(merkle_files(spark, d))


@register(f"WITH {_MERKLE_SQL} SELECT sha256(string_agg(path || ':' || hash, '|' ORDER BY path)) AS hash, count(*) AS files FROM f")
def merkle_root(spark, d):
    return state.merkle_root(merkle_files(spark, d))


@register(f"WITH {_DELTA_SQL} SELECT path, status FROM delta WHERE status <> 'unchanged'")
def merkle_diff(spark, d):
    whole = lambda f: state.merkle_files(state.merkle_chunks(f.select("path", "text", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))))
    a, b = _snapshots(spark, d)
    return state.merkle_diff(whole(a), whole(b))


@register(f"WITH {_MERKLE_SQL} SELECT content AS content_hash, count(*) AS copies, count(DISTINCT path) AS files FROM c GROUP BY content HAVING count(*) >= 2")
def duplicate_chunks(spark, d):
    return state.duplicate_chunks(state.merkle_chunks(_line_rows(_files(spark, d))))


_EVENTS = "SELECT user_id::VARCHAR AS path, event_type, event_id AS seq, ts FROM events"


def _events(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"), "ts")


@register(f"WITH e AS ({_EVENTS}) SELECT path, CASE WHEN max_by(event_type, seq) = 'purchase' THEN 'delete' ELSE 'upsert' END AS op FROM e GROUP BY path")
def dirty_set(spark, d):
    op = F.when(F.col("op") == "purchase", "unlink").otherwise(F.col("op"))
    return state.dirty_set(_events(spark, d).withColumn("op", op))


@register(f"""WITH e AS ({_EVENTS}), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, seq) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, seq) AS run FROM g)
    SELECT path, arg_max(event_type, (ts, seq)) AS op, count(*) AS events FROM s GROUP BY path, run""")
def debounce_events(spark, d):
    return stream.debounced(_events(spark, d), "1 hour", stream=False).select("path", "op", "events")


@register(f"WITH e AS ({_EVENTS}) SELECT path, max(seq) AS seq, max_by(event_type, seq) AS op FROM e GROUP BY path")
def keep_latest(spark, d):
    return stream.latest(_events(spark, d))


# policy, paths

_NAMES = ["src/app.ts", "node_modules/x/y.js", ".env", "a.min.png", "docs/readme.md", "dist/out.js", "lib/deep/mod.py", "Makefile", "photo.JPG", "Dockerfile", "styles/site.scss", "x.lock"]
_NAMES_SQL = "names AS (SELECT doc_id AS id, [" + ", ".join(f"'{n}'" for n in _NAMES) + f"][(doc_id % {len(_NAMES)} + 1)::INT] AS path, n_chars AS length FROM documents)"


def _named(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int")).alias("path"), F.col("n_chars").alias("length"))


@register(f"""WITH {_NAMES_SQL} SELECT id, path, CASE WHEN path IN ('node_modules/x/y.js', '.env', 'dist/out.js', 'x.lock') THEN 'hardcoded' WHEN path = 'lib/deep/mod.py' THEN 'user-exclude'
    WHEN path IN ('a.min.png', 'photo.JPG') THEN 'binary' WHEN length > 2048 THEN 'size' WHEN path NOT IN ('src/app.ts', 'docs/readme.md', 'styles/site.scss') THEN 'include-mismatch' END AS category FROM names""")
def policy_category(spark, d):
    rules = policy.Policy(include=("**/*.{ts,md,scss}",), exclude=("lib/**",), max_size=2048)
    return policy.classify(_named(spark, d), rules).select("id", "path", "category")


@register(f"WITH {FILES_SQL}, m AS (SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^src1[^/]*/[^/]*\\.(en|de)$')) SELECT path, (SELECT count(*) FROM m) AS total_matches FROM m ORDER BY path LIMIT 20")
def path_glob(spark, d):
    return paths.by_glob(_files(spark, d), "src1*/*.{en,de}", 20)


@register(f"WITH {FILES_SQL} SELECT DISTINCT path FROM files WHERE path LIKE 'src2%.fr' ORDER BY path LIMIT 20")
def path_like(spark, d):
    return paths.by_like(_files(spark, d), "src2*.fr", 20)


@register(f"""WITH {_NAMES_SQL} SELECT id, CASE WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.py' THEN 'python' WHEN path = 'Makefile' THEN 'shell'
    WHEN path = 'Dockerfile' THEN 'dockerfile' WHEN path LIKE '%.scss' THEN 'scss' ELSE 'unknown' END AS language FROM names""")
def language_detect(spark, d):
    return _named(spark, d).select("id", paths.language("path").alias("language"))


# queries

_ASKED = ["user authentication error", "find database query", "UserService class", "how does async api work", "config settings", "unit test coverage for login", "zzz"]


_ASKED_SQL = "q AS (SELECT unnest({}) AS query)".format(_ASKED)
_DICT_SQL = "d AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {t.split()})" for w, t in query.EXPANSIONS.items()) + ") AS v(word, terms))"
_INTENT_SQL = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', {words.lower().split()}, {patterns}, {base}::DOUBLE)" for i, (c, (words, patterns, base)) in enumerate(query.INTENTS.items())) + ") AS v(place, category, keys, patterns, base))"


def _queries(spark) -> DataFrame:
    return spark.createDataFrame([(q,) for q in _ASKED], "query string")


@register(f"""WITH {_ASKED_SQL}, {_DICT_SQL}, w AS (SELECT query, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT query, string_split_regex(lower(trim(query)), '\\s+') AS ws FROM q)),
    t AS (SELECT query, ws, i, unnest(terms) AS term, generate_subscripts(terms, 1) AS j FROM w JOIN d USING (word)),
    f AS (SELECT query, term, min(i * 1000 + j) AS o FROM t WHERE NOT list_contains(ws, term) GROUP BY query, term),
    r AS (SELECT query, list(term ORDER BY o)[1:10] AS terms FROM f GROUP BY query)
    SELECT q.query, coalesce(terms, []::VARCHAR[]) AS terms, trim(q.query) || coalesce(' ' || array_to_string(terms, ' '), '') AS expanded FROM q LEFT JOIN r USING (query)""")
def query_expansion(spark, d):
    return queries.expanded(_queries(spark))


@register(f"""WITH {_ASKED_SQL}, {_INTENT_SQL}, t AS (SELECT query, lower(query) AS low, regexp_extract_all(lower(replace(replace(regexp_replace(query, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '-', ' ')), '[a-z0-9]+') AS ts FROM q),
    h AS (SELECT query, place, category, base, len(list_filter(keys, lambda x: list_contains(ts, x) OR regexp_matches(low, '\\b' || x || '\\b'))) AS hits, len(list_filter(patterns, lambda p: regexp_matches(low, p))) > 0 AS matched FROM t, k),
    c AS (SELECT *, CASE WHEN hits > 1 THEN least(1.0::DOUBLE, base + 0.1::DOUBLE * (hits - 1)) ELSE base END AS sure FROM h WHERE hits > 0 OR matched),
    e AS (SELECT *, floor(CASE WHEN matched THEN least(1.0::DOUBLE, sure + 0.15::DOUBLE) ELSE sure END * 100 + 0.5) / 100 AS confidence FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, place) AS rank FROM e WHERE confidence >= 0.3)
    SELECT query, rank::INT AS rank, category, confidence FROM r WHERE rank <= 3""")
def intent_detect(spark, d):
    return queries.intents(_queries(spark))


# ranking

_RESULTS_SQL = """res AS (SELECT doc_id AS id, (n_chars % 1000) / 1000.0::DOUBLE AS score, source || '/auth/' || doc_id || '.ts' AS path, n_chars AS len,
    ['function', 'class', 'method', 'module', NULL, 'struct'][(doc_id % 6 + 1)::INT] AS ty, ['loginUser', 'UserAuth', 'parse_config', NULL, 'user'][(doc_id % 5 + 1)::INT] AS nm, doc_id % 4 = 0 AS has_doc FROM documents)"""


def _results(spark, d):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), F.concat("source", F.lit("/auth/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"),
        "text", pick(["function", "class", "method", "module", None, "struct"]).alias("chunk_type"), pick(["loginUser", "UserAuth", "parse_config", None, "user"]).alias("chunk_name"),
        F.array().cast("array<string>").alias("chunk_tags"), F.when(F.col("doc_id") % 4 == 0, "A docstring.").alias("chunk_docstring"),
    )


# "user auth": intent auth, two tokens, so the entity profile of type boosts holds
_FACTORS_SQL = f"""{_RESULTS_SQL}, fac AS (SELECT id, score,
    CASE ty WHEN 'class' THEN 1.15 WHEN 'struct' THEN 1.15 WHEN 'function' THEN 1.1 WHEN 'method' THEN 1.1 WHEN 'module' THEN 0.92 ELSE 1.0 END::DOUBLE AS type_boost,
    CASE nm WHEN 'UserAuth' THEN 1.3 WHEN 'loginUser' THEN 1.2 WHEN 'user' THEN 1.2 ELSE 1.0 END::DOUBLE AS name_boost, 1.05::DOUBLE AS path_boost, 1.0::DOUBLE AS tag_boost,
    CASE WHEN NOT has_doc THEN 1.0::DOUBLE WHEN ty = 'module' THEN 1.0::DOUBLE + (1.05::DOUBLE - 1.0::DOUBLE) * 0.4::DOUBLE ELSE 1.05::DOUBLE END AS docstring_bonus, CASE WHEN len > 4000 THEN 0.95 WHEN len > 2000 THEN 0.98 ELSE 1.0 END::DOUBLE AS length_penalty FROM res),
    fin AS (SELECT *, score * type_boost * name_boost * path_boost * tag_boost * docstring_bonus * length_penalty AS final_score FROM fac)"""


@register(f"WITH {_FACTORS_SQL} SELECT id, type_boost, name_boost, path_boost, tag_boost, docstring_bonus, length_penalty, final_score FROM fin ORDER BY final_score DESC, id")
def rank_factors(spark, d):
    got = ranking.rank(_results(spark, d), "user auth")
    return got.select("id", *ranking.FACTORS, "final_score")


@register(f"""WITH {_FACTORS_SQL}, top AS (SELECT * FROM fin ORDER BY score DESC, id LIMIT 100),
    p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS was, row_number() OVER (ORDER BY final_score DESC, score DESC, id) AS now FROM top)
    SELECT round(avg(type_boost), 6) AS avg_type, round(max(name_boost), 6) AS max_name, round(avg(final_score / score - 1), 6) AS avg_improvement, count(*) FILTER (was <> now) AS reordered FROM p""")
def rank_stats(spark, d):
    top = _results(spark, d).orderBy(F.desc("score"), "id").limit(100)
    s = ranking.statistics(ranking.rank(top, "user auth"))
    return s.select(F.round("avg_type_boost", 6).alias("avg_type"), F.round("max_name_boost", 6).alias("max_name"), F.round("avg_improvement", 6).alias("avg_improvement"), "reordered")


# texts to rows

TOKENS_SQL = "SELECT doc_id, len(regexp_extract_all(lower(replace(replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '-', ' ')), '[a-z0-9]+'))::BIGINT AS n FROM documents"


@register(TOKENS_SQL)
def identifier_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(T.identifier_tokens("text")).cast("long").alias("n"))


@register(f"""WITH {FILES_SQL}, l AS (SELECT path, string_split(text, chr(10)) AS ls FROM files), s AS (SELECT path, ls, unnest(range(0, len(ls), 20)) AS s FROM l)
    SELECT path, (s + 1)::INT AS start_line, least(s + 20, len(ls))::INT AS end_line, md5(array_to_string(ls[s + 1 : s + 20], chr(10))) AS text_md5 FROM s""")
def fixed_line_chunks(spark, d):
    return chunking.line_chunks(_files(spark, d)).select("path", "start_line", "end_line", F.md5("text").alias("text_md5"))


@register(f"""WITH {FILES_SQL}, l AS (SELECT path, string_split(text, chr(10)) AS ls FROM files), c AS (SELECT path, len(ls)::INT AS total, len(list_filter(ls, lambda x: trim(x) = ''))::INT AS blank,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(//|#|/\\*|\\*)')))::INT AS comment FROM l) SELECT *, greatest(0, total - blank - comment)::INT AS code FROM c""")
def line_counts(spark, d):
    return chunking.line_counts(_files(spark, d))


@register("""WITH f AS (SELECT source AS path, (n_chars % 9)::INT AS complexity, (n_chars % 7)::INT AS nesting FROM documents),
    g AS (SELECT path, sum(complexity)::BIGINT AS cyclomatic, avg(complexity) AS mean, max(nesting) AS max_nesting, count(*) AS functions FROM f GROUP BY path)
    SELECT path, cyclomatic, max_nesting, functions, floor(mean * 100 + 0.5) / 100 AS avg,
    greatest(0, 100 - (CASE WHEN cyclomatic > 50 THEN 20 WHEN cyclomatic > 30 THEN 15 WHEN cyclomatic > 20 THEN 10 WHEN cyclomatic > 10 THEN 5 ELSE 0 END)
      - (CASE WHEN mean > 15 THEN 15 WHEN mean > 10 THEN 10 WHEN mean > 5 THEN 5 ELSE 0 END) - (CASE WHEN max_nesting > 6 THEN 15 WHEN max_nesting > 4 THEN 10 WHEN max_nesting > 3 THEN 5 ELSE 0 END)
      - (CASE WHEN functions > 50 THEN 10 WHEN functions > 30 THEN 5 ELSE 0 END))::INT AS score FROM g""")
def complexity_score(spark, d):
    f = _t(spark, d, "documents").select(F.col("source").alias("path"), (F.col("n_chars") % 9).cast("int").alias("complexity"), (F.col("n_chars") % 7).cast("int").alias("nesting"))
    return chunking.complexity(f)


def _chunk_digest(df: DataFrame) -> DataFrame:
    return df.select("id", "path", "start_line", "end_line", F.length("text").alias("chars"), "chunk_hash", "chunk_type", "chunk_name")


@register()
def recursive_chunks(spark, d):
    return _chunk_digest(chunking.chunked(_files(spark, d)))


@register()
def document_chunks(spark, d):
    f = _files(spark, d).withColumn("path", F.concat("path", F.lit(".md"))).withColumn("text", F.concat(F.lit("# Title\n\n"), "text"))
    return _chunk_digest(chunking.chunked(f, "document"))


def _pages(spark, d):
    return _t(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))


@register()
def code_aware_chunks(spark, d):
    return _chunk_digest(chunking.chunked(_pages(spark, d), "code-aware"))


@register()
def file_summaries(spark, d):
    return chunking.summarized(_pages(spark, d)).select("path", "language", "total", "code", "blank", "comment", "score")


@register()
def code_comments(spark, d):
    src = F.concat(F.lit("def f_"), F.col("doc_id").cast("string"), F.lit('(x):\n    """'), F.regexp_replace("text", r'["\\\n]', " "), F.lit('"""\n    return x\n'))
    f = _t(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), src.alias("text"))
    return chunking.comment_rows(f).select("id", "path", "start_line", "end_line", "chunk_name")


# evaluation

@register("SELECT doc_id, floor(length(text) / 4.0 + 0.5)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@register("""WITH r AS (SELECT doc_id % 10 AS query_id, source || '/' || doc_id AS path, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    h AS (SELECT query_id, path, list_filter(['src1', 'src7/', 'SRC15'], lambda w: contains(lower(path), lower(w))) AS hit FROM r WHERE rank <= 5),
    g AS (SELECT query_id, count(*) FILTER (len(hit) > 0) AS n, len(list_distinct(flatten(list(hit)))) AS hits FROM h GROUP BY query_id)
    SELECT query_id, n / 5 AS precision, hits::BIGINT AS hits, CASE WHEN n / 5 >= 0.6 THEN 'HIGH' WHEN n / 5 >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS rating FROM g""")
def precision_at_k(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    r = _t(spark, d, "documents").select((F.col("doc_id") % 10).alias("query_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "n_chars", "doc_id")
    r = r.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "path")
    e = spark.range(10).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("src1"), F.lit("src7/"), F.lit("SRC15"))).alias("wanted"))
    return evaluation.rated(evaluation.precision_at(r, e, 5))


@register("SELECT count(*) AS files, coalesce(sum(n), 0)::BIGINT AS matches, coalesce(sum(c), 0)::BIGINT AS chars FROM (SELECT len(regexp_extract_all(text, '(?i)license')) AS n, length(text) AS c FROM documents) WHERE n > 0")
def grep_simulation(spark, d):
    return evaluation.grep(_t(spark, d, "documents"), "license", path="doc_id")


@register("SELECT source AS config, round(avg(n_chars), 6) AS avg, min(n_chars) AS min, max(n_chars) AS max, count(*) AS queries FROM documents GROUP BY source")
def config_summary(spark, d):
    return evaluation.summaries(_t(spark, d, "documents"), "source", "n_chars").select(F.col("source").alias("config"), F.round("avg", 6).alias("avg"), "min", "max", "queries")


@register("SELECT count(*) AS chunks, count(DISTINCT path) AS files FROM (SELECT source || '/' || doc_id || '.' || lang AS path FROM documents)")
def store_counts(spark, d):
    return _stored(spark, d).counts()


def _stored(spark, d) -> ChunkStore:
    """Half of the files as one chunk each, the other half appended."""
    rows = _files(spark, d).select(F.col("doc_id").alias("id"), "path", "text", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    store = ChunkStore(spark, work_folder(spark, "store"), 8)
    store.write(rows.where("id % 2 = 0"))
    store.append(rows.where("id % 2 <> 0"))
    return store


@register(f"WITH {FILES_SQL} SELECT doc_id AS id, path, sha256(text) AS hash FROM files")
def store_append(spark, d):
    return _stored(spark, d).read().select("id", "path", F.sha2("text", 256).alias("hash"))


@register(f"WITH {FILES_SQL} SELECT doc_id AS id, path FROM files WHERE path = (SELECT path FROM files WHERE doc_id = 14)")
def store_of_path(spark, d):
    path = _files(spark, d).where("doc_id = 14").first()["path"]
    return _stored(spark, d).of_path(path).select("id", "path")


@register(f"WITH {FILES_SQL} SELECT doc_id AS id, path FROM files WHERE doc_id % 7 <> 0 AND doc_id NOT IN (8, 15, 23)")
def store_delete(spark, d):
    store = _stored(spark, d)
    store.delete_ids(store.read().where("id % 7 = 0").select("id"))
    store.delete_paths([r.path for r in _files(spark, d).where("doc_id IN (8, 15, 23)").collect()])
    return store.read().select("id", "path")


@register(f"WITH {FILES_SQL} SELECT doc_id AS id, path, sha256(CASE WHEN doc_id % 5 = 0 THEN 'replaced' ELSE text END) AS hash FROM files WHERE doc_id % 11 <> 0")
def store_replace(spark, d):
    store = _stored(spark, d)
    rows = store.read()
    gone = rows.where("id % 5 = 0 OR id % 11 = 0").select("path")
    store.replace_paths(gone, rows.where("id % 5 = 0 AND id % 11 <> 0").withColumn("text", F.lit("replaced")))
    return store.read().select("id", "path", F.sha2("text", 256).alias("hash"))


@register("SELECT doc_id, source, n_chars FROM documents")
def sidecar_roundtrip(spark, d):
    path = work_folder(spark, "sidecar")
    rows = _t(spark, d, "documents").select("doc_id", "source", "n_chars")
    write_json(rows, path)
    return read_json(spark, path, rows.schema)


# the engine


def _hashed(files: DataFrame) -> DataFrame:
    return files.select("path", "text", F.sha2("text", 256).alias("content_hash"))


def _built(spark, d) -> Engine:
    engine = Engine(spark, work_folder(spark, "engine"), Config(extract_comments=False))
    engine.build(_hashed(_snapshots(spark, d)[0]))
    return engine


@register(f"WITH {_DELTA_SQL} SELECT status, count(*) AS files FROM delta GROUP BY status")
def engine_reconcile(spark, d):
    """The first snapshot indexed, then brought up to the second: what changed."""
    return _built(spark, d).apply(_hashed(_snapshots(spark, d)[1]))


@register(f"""WITH {_DELTA_SQL}, s AS (SELECT path, 'fingerprint' AS kind, hash FROM b)
    SELECT kind, path, hash FROM s UNION ALL SELECT 'chunks' AS kind, path, NULL AS hash FROM b WHERE hash <> sha256('')""")
def engine_index_after_reconcile(spark, d):
    """Fingerprints and the files that have chunks once the index is up to the second snapshot."""
    engine = _built(spark, d)
    engine.apply(_hashed(_snapshots(spark, d)[1]))
    prints = engine.prints.read().select(F.lit("fingerprint").alias("kind"), "path", "hash")
    chunks = engine.code.read().select(F.lit("chunks").alias("kind"), "path", F.lit(None).cast("string").alias("hash")).distinct()
    return prints.unionByName(chunks)


@register("SELECT 'ready' AS status, count(*) AS files FROM documents")
def engine_status(spark, d):
    return _built(spark, d).status().select("status", "files")


@register(f"WITH {FILES_SQL} SELECT path, sha256(CASE WHEN doc_id = 14 THEN 'one new text' ELSE text END) AS hash FROM files WHERE doc_id <> 15")
def engine_reindex_file(spark, d):
    """One file's text changed and one file gone, each by its path."""
    engine, files = _built(spark, d), _files(spark, d)
    new = _hashed(files.where("doc_id <> 15").withColumn("text", F.when(F.col("doc_id") == 14, "one new text").otherwise(F.col("text"))))
    for r in files.where("doc_id IN (14, 15)").select("path").collect():
        engine.reindex_file(new, r.path)
    return engine.prints.read().select("path", "hash")


@register(f"WITH {FILES_SQL}, m AS (SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^src1[^/]*/[^/]*\\.(en|de)$')) SELECT path, (SELECT count(*) FROM m) AS total_matches FROM m ORDER BY path LIMIT 20")
def engine_paths(spark, d):
    return _built(spark, d).paths("src1*/*.{en,de}", 20)


@register("SELECT doc_id AS id, source || '/' || doc_id || '.' || lang AS path FROM documents WHERE doc_id IN (3, 14, 159)")
def lookup_ids(spark, d):
    ids = spark.createDataFrame([(3,), (14,), (159,), (159,)], "id long")
    rows = _files(spark, d).select(F.col("doc_id").alias("id"), "path", "text", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    return lookup(rows, ids).select("id", "path")
