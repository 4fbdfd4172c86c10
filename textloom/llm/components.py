"""Connected components of an edge table, without any of it on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import discard, in_arrow, stash

EDGE = "a long, b long"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the least of its component."""
    got = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches]
    if not got:
        return
    a, b = (np.concatenate([x[k] for x in got]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (again := new[new]).tobytes() != new.tobytes():
            new = again
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long) but the roots
    themselves; root is the least node that it reaches.

    First each partition contracts its own edges to stars, then large-star and
    small-star rounds run until the edges stay the same. Every round is written
    to the shared folder. No row of it goes to the driver but a count and a sum.
    Nulls and loops are no edges; an empty table gives an empty result.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    told = Observation()
    now = stash(in_arrow(edges.distinct(), _contract, EDGE).distinct().observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
    seen = told.get  # stars that a round leaves as they are: done
    if not seen["n"]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        told = Observation()
        before, now = now, stash(small.distinct().observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        discard(before)
        is_now = told.get
        if is_now == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = is_now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
