"""How good results are: precision, hits, ratings, token economy, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH, MEDIUM = 0.6, 0.3


def precision_at(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision, hits): results (query_id, rank, path) against expected
    (query_id, wanted): the share of the first k whose path contains a wanted string, case
    aside, and the number of different wanted strings found. Divided by k however few there are."""
    top = results.where(F.col("rank") <= k)
    by = expected.groupBy("query_id").agg(F.collect_set(F.lower("wanted")).alias("wanted"))
    found = top.join(by, "query_id").withColumn("__hit", F.filter("wanted", lambda w: F.lower(F.col("path")).contains(w)))
    per = found.groupBy("query_id").agg(F.count_if(F.size("__hit") > 0).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("__hit")))).alias("hits"))
    return by.join(per, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("precision"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def rated(precisions: DataFrame) -> DataFrame:
    p = F.col("precision")
    return precisions.withColumn("rating", F.when(p >= HIGH, "HIGH").when(p >= MEDIUM, "MEDIUM").otherwise("LOW"))


def grep(docs: DataFrame, pattern: str, path: str = "path", text: str = "text") -> DataFrame:
    """One row: files with a match, matches, and characters one would read for them."""
    n = F.regexp_count(F.col(text), F.lit(f"(?i){pattern}"))
    hit = docs.select(F.col(path).alias("path"), n.alias("n"), F.length(text).alias("chars")).where("n > 0")
    return hit.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("chars"))


def summaries(runs: DataFrame, config: str = "config", metric: str = "precision") -> DataFrame:
    return runs.groupBy(config).agg(F.avg(metric).alias("avg"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.count("*").alias("queries"))


def best(summary: DataFrame, config: str = "config") -> DataFrame:
    return summary.orderBy(F.desc("avg"), config).limit(1)


def compare(summary: DataFrame, a: str, b: str, config: str = "config") -> DataFrame:
    """avg of config ``a`` less that of ``b``."""
    pick = lambda c: F.max(F.when(F.col(config) == c, F.col("avg")))
    return summary.agg(pick(a).alias("a"), pick(b).alias("b"), (pick(a) - pick(b)).alias("difference"))
