"""Mixing sources to target weights.

Each document gets a hash-random key; within each source documents are sorted by
it and taken in order until the source's budget of words is met, epoch after epoch.
The order is found in two steps that keep every task small: equal ranges of the
key cut each source into buckets (a hot source into as many as it has rows for),
bucket totals give each bucket's start by a running sum over buckets, and a
running sum inside each bucket gives each document's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, stash, table

WEIGHTS = (3, 1, 2)  #: by rank of the source, repeating
SHARE, CAP = 1.5, 2  #: of all words; most epochs of a source
BUCKET = 20_000  #: rows of a bucket, about


ROW = ("__k1", "__k2")


def row_key(docs: DataFrame) -> list:
    """128 bits of hash of what tells rows apart here: doc_id, source and text, nulls told from values."""
    told = [x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(k), *told).alias(name) for k, name in enumerate(ROW)]


def sizes(docs: DataFrame, keyed: bool = False) -> DataFrame:
    return docs.select(*(row_key(docs) if keyed else []), "doc_id", "source", F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))).alias("key"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target. Sources weigh by their rank by code point (null
    last). The level x of words per weight is the one at which the targets
    min(weight * x, cap * size) sum up to ``share`` of all words: sources are
    capped in the order of size over weight, so running sums find it.

    One row per source: windows over all of them hold no document."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1))
    ratio = F.col("source_size") * float(cap) / F.col("w")
    order = W.orderBy(ratio, F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    by = by.select("source", "source_size", "w", ratio.alias("r"), F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s"), F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("t"), F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)).alias("wr"))
    # the level if exactly the sources before this one are capped: rises while a source's
    # own ratio is below it, falls from the first on that is not, so the largest is the level
    by = by.withColumn("x", (F.col("t") * float(share) - F.col("s") * float(cap)) / F.col("wr"))
    level = F.max("x").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return by.withColumn("x", level).select("source", "source_size", F.least(F.col("w") * F.col("x"), F.col("source_size") * float(cap)).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, keyed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken; with ``keyed``
    also the hashes of ``row_key``, by which ties go then at last.

    A source's whole epochs take each of its documents whole; the rest of its
    budget takes documents in key order, the one at the edge in part, so taken words
    sum up to the target rounded down. Keys come from doc_id, without one from the
    text; their ties go by doc_id, then by size, and rows equal in all that are alike in
    every column: reruns agree, however rows are dealt. A null or empty
    text has size 0; null is a source, ordered last. Empty table: empty result.
    Extra columns are not read.
    """
    keys = ROW if keyed else ()
    sized = stash(sizes(docs, keyed), "sizes")
    # equal key ranges: 4 hex digits are fine enough to hold BUCKET rows of the largest source
    aims = stash(targets(sized, weights, share, cap), "targets")
    n = sized.count()
    buckets = min(1 << 16, max(64, -(-n // BUCKET)))
    cut = (F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("long")
    sized = sized.withColumn("bucket", cut)
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    starts = totals.select(F.col("source").alias("src"), F.col("bucket").alias("b"), (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("start"))
    starts = starts.join(aims, F.col("src").eqNullSafe(F.col("source"))).select("src", "b", "start", "source_size", "target")
    placed = sized.join(starts, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("b")))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("start") + F.sum("size").over(inside) - F.col("size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    placed = placed.select(*keys, "doc_id", "source", "size", "source_size", "target", before.alias("before"), epochs.cast("long").alias("epochs"), budget.cast("long").alias("budget"))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return placed.select(*keys, "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself. A document is repeated once for each epoch that
    takes it, whole but for the one at a budget's edge, cut behind its last taken
    word; documents of no taken word go. Each row has its own share, whatever its doc_id;
    rows of equal doc_id, source and text are dealt theirs in falling order."""
    taken = mix(docs, keyed=True).where("taken > 0").groupBy(*ROW).agg(F.sort_array(F.collect_list("taken"), asc=False).alias("__all"), F.max("size").alias("__size"))
    # the whole row travels as one column, so none of its names can clash with these
    rows = docs.select(F.struct("*").alias("__row"), *row_key(docs))
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy(*ROW).orderBy(*ROW)))
    rows = rows.join(taken, list(ROW)).where(F.col("__n") <= F.size("__all")).withColumn("__taken", F.element_at("__all", F.col("__n")))
    takes = F.expr("transform(sequence(1, CAST(ceil(__taken / __size) AS INT)), i -> least(__size, __taken - (i - 1) * __size))")
    rows = rows.select("__row", "__size", F.explode(takes).alias("__take"))
    own = F.col("__row.text")
    # pieces begin with a word, but the first of a text that begins with white space
    pieces = F.split(own, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    first = F.when(own.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0)
    part = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (F.col("__take") + first).cast("int")), ""), r"[\x20\x09-\x0D]+\z", "")
    text = F.when(F.col("__take") < F.col("__size"), part).otherwise(own)
    out = rows.select("__row", text.alias("__text"))
    made = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("__text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share; see ``mix`` for nulls, empty texts and repeated rows."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE / w AS r FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped, sum(source_size) OVER ()::DOUBLE AS t,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr FROM r WINDOW o AS (ORDER BY r, source NULLS LAST)),
x AS (SELECT *, (t * 1.5::DOUBLE - capped * 2.0::DOUBLE) / wr AS x FROM c),
g AS (SELECT source, source_size, least(w * (SELECT max(x) FROM x), source_size * 2.0::DOUBLE) AS target FROM x),
p AS (SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
             CASE WHEN g.source_size > 0 THEN floor(floor(target) / g.source_size) ELSE 0 END::BIGINT AS epochs
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM p
"""
