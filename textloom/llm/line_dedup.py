"""Line dedup by distinct-site spread, with DataFrame functions alone.

How many sites a line is found on is estimated by a HyperLogLog sketch per line
hash, merged by aggregation: sketches combine before the shuffle, so a line that
a third of all rows share costs each task one row. Estimates clear of the
threshold decide; lines within ``band`` of it get an exact distinct count. A line
found on ``sites`` sites or more is boilerplate: its first occurrence (smallest
doc_id, then place) stays, every other goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stash, table

SITES = 10  #: distinct sites that make a line boilerplate
LG_K = 12  #: 4,096 registers: a standard error of 1.6 %
BAND = 0.15  #: about nine standard errors to either side


def _key(line: Column) -> list[Column]:
    """128 bits of hash; a line's white space at either end does not count."""
    clean = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return [F.xxhash64(clean).alias("k1"), F.xxhash64(F.lit(1), clean).alias("k2")]


def boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES, lg_k: int = LG_K, band: float = BAND) -> tuple[DataFrame, DataFrame]:
    """(all lines, boilerplate lines): lines have k1, k2, doc_id, t (hash of the text),
    pos and site; boilerplate has k1, k2 and its first occurrence."""
    # hashed before lines part, so once a text and not once a line
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"))
    lines = hashed.select("doc_id", "t", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(r"line rlike '[^\\x20\\x09-\\x0D]'").select("doc_id", "t", "site", "pos", *_key(F.col("line")))
    first = F.min(F.struct("doc_id", "pos", "t")).alias("first")
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), first)
    spread = spread.select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= sites * (1 - band))
    spread = stash(spread, "spread")
    near = spread.where(F.col("sites") <= sites * (1 + band))
    exact = lines.join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "site").distinct().groupBy("k1", "k2").count().where(F.col("count") >= sites)
    sure = spread.where(F.col("sites") > sites * (1 + band))
    found = sure.select("k1", "k2", "first").union(near.join(exact, ["k1", "k2"], "left_semi").select("k1", "k2", "first"))
    return lines, stash(found, "boilerplate")


def dedup_lines(docs: DataFrame, site: str = "source", sites: int = SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """``docs`` with cross-site boilerplate lines removed from ``text``, and a column
    ``removed_lines``. Rows, other columns and order of lines stay.

    A null site counts as a site of its own; a null text stays null; a text of
    boilerplate alone becomes empty. Rows that repeat a doc_id and text are one
    occurrence. A null doc_id comes first. Blank lines are never boilerplate.
    """
    if "removed_lines" in docs.columns:
        docs = docs.drop("removed_lines")
    lines, found = boilerplate(docs, site, sites, lg_k, band)
    own = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.pos") == F.col("pos")) & (F.col("first.t") == F.col("t"))
    hits = lines.select("k1", "k2", "doc_id", "t", "pos").join(found, ["k1", "k2"]).where(~own)
    gone = hits.groupBy(F.col("doc_id").alias("__d"), F.col("t").alias("__t")).agg(F.collect_set("pos").alias("__gone"))
    # the whole row travels as one column, so none of its names can clash with these
    keyed = docs.select(F.struct("*").alias("__row"), F.xxhash64("text").alias("__h"))
    joined = keyed.join(gone, F.col("__row.doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")), "left")
    own_text = F.col("__row.text")

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(places, lambda i: lines[i]), "\n")

    # the text is parted once, as the variable of a function, and looked up by place
    cut = F.transform(F.array(F.split(own_text, "\n")), left)[0]
    text = F.when(F.col("__gone").isNull(), own_text).otherwise(cut)
    return joined.select(*[(text if c == "text" else F.col("__row")[c]).alias(c) for c in docs.columns], F.coalesce(F.size("__gone"), F.lit(0)).alias("removed_lines"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without cross-site boilerplate lines; n_chars follows."""
    out = dedup_lines(docs).drop("removed_lines")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed_lines, n_chars and md5 of the text left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("removed_lines").cast("long").alias("removed_lines"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


#: Distinct sites are counted exactly here: the answer that sketches must not change.
OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, md5(text) AS t, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS told, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS clean FROM l),
b AS (SELECT clean, min({'d': doc_id, 'p': pos}) AS first FROM k WHERE told GROUP BY clean HAVING count(DISTINCT site) >= 10),
j AS (SELECT k.*, b.clean IS NOT NULL AND NOT (b.first.d = k.doc_id AND b.first.p = k.pos) AS gone FROM k LEFT JOIN b ON k.told AND k.clean = b.clean)
SELECT doc_id, count(*) FILTER (gone)::BIGINT AS removed_lines,
       length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))::BIGINT AS n_chars,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM j GROUP BY doc_id
"""
