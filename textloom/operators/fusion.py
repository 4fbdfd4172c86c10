"""Reciprocal rank fusion of two ranked lists, and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
MOST = 100


def alpha_of(alpha: float | None, default: float = 0.5) -> float:
    return min(1.0, max(0.0, default if alpha is None or alpha != alpha else alpha))


def mode_of(mode: str | None) -> str:
    return mode if mode in ("vector", "fts", "hybrid") else "hybrid"


def rrf(vector_rank: Column, fts_rank: Column, alpha: float = 0.5) -> Column:
    """alpha / (60 + rank) of the one list and (1 - alpha) / (60 + rank) of the other; absent: 0."""
    part = lambda w, r: F.when(r.isNotNull(), F.lit(float(w)) / (F.lit(float(RRF_K)) + r)).otherwise(F.lit(0.0))
    return part(alpha, vector_rank) + part(1 - alpha, fts_rank)


def fuse(vector: DataFrame, fts: DataFrame, k: int = 10, alpha: float = 0.5, literal_ids: bool = False) -> DataFrame:
    """(id, score, vector_rank, fts_rank): both lists (id, rank) joined by id, the k best by
    fused score, as shares of the best. Ties: the vector list first, each in rank order.

    ``literal_ids`` keeps the lists apart: an id of both appears twice.
    """
    v, f = vector.select("id", F.col("rank").alias("vector_rank")), fts.select("id", F.col("rank").alias("fts_rank"))
    if literal_ids:
        both = v.withColumn("fts_rank", F.lit(None).cast("int")).unionByName(f.withColumn("vector_rank", F.lit(None).cast("int")))
    else:
        both = v.join(f, "id", "full_outer")
    scored = both.withColumn("raw", rrf(F.col("vector_rank"), F.col("fts_rank"), alpha))
    top = scored.orderBy(F.desc("raw"), F.asc_nulls_last("vector_rank"), "fts_rank").limit(k)
    best = F.max("raw").over(Window.partitionBy())  # over k rows
    score = F.when(best > 0, F.least(F.lit(1.0), F.col("raw") / best)).otherwise(F.lit(0.0))
    return top.select("id", score.alias("score"), "vector_rank", "fts_rank")


def overfetch(k: int) -> int:
    return min(2 * k, MOST)
