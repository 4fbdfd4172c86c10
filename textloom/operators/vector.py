"""Nearest vectors: exact top-k for one query or many, and an inverted-file index."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..functions.nearest import Nearest

MAX_K = 100
#: When an index is worth building, and its shape.
INDEX_LEAST_ROWS, INDEX_MOST_PARTITIONS = 10_000, 256


def top_k(rows: DataFrame, query: Sequence[float], k: int = 10, metric: str = "l2", *, id_col: str = "id", vector_col: str = "vector", squared: bool = True, clamp: int | None = MAX_K) -> DataFrame:
    """The ``k`` rows nearest to ``query`` with ``distance`` and ``score``, nearest
    first, ties to smaller ids. Planned as TakeOrderedAndProject: each task keeps k rows.

    Rows without a vector, or with one of another dimension, take no part.
    """
    k = max(1, min(k, clamp) if clamp else k)
    fit = rows.where(F.size(vector_col) == len(query))
    d = fit.withColumn("distance", V.distance(vector_col, V.literal(query), metric, squared))
    return d.withColumn("score", V.score(F.col("distance"))).orderBy("distance", id_col).limit(k)


def check_dimension(rows: DataFrame, query: Sequence[float], vector_col: str = "vector") -> None:
    first = rows.where(F.col(vector_col).isNotNull()).select(F.size(vector_col).alias("n")).first()
    if first and first.n != len(query):
        raise ValueError(f"the query has {len(query)} dimensions, the table {first.n}")


#: Query vectors broadcast at most this many bytes; more run in blocks.
BROADCAST_BYTES = 64 << 20


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", *, id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query", most_queries: int = 10_000) -> DataFrame:
    """``top_k`` for a table of queries: query_id, rank, id, distance, score.

    The queries are a stated, bounded set (an error above ``most_queries``): they go to
    every task, and the rows are read once for every ``BROADCAST_BYTES`` of queries. A task
    keeps k rows per query; a matrix product tells which rows may be among them, and only
    their distances are computed in component order. Vectors that hold null take no part.
    """
    q = queries.select(F.col(query_id).alias("q_id"), F.col(query_vector).cast("array<double>").alias("q_v")).where("q_v is not null")
    n, numbers = q.agg(F.count("*"), F.coalesce(F.sum(F.size("q_v")), F.lit(0))).first()
    if n > most_queries:
        raise ValueError(f"{n} queries: run them in blocks of {most_queries}")
    blocks = max(1, -(-8 * numbers // BROADCAST_BYTES))
    of = [q.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b) if blocks > 1 else q for b in range(blocks)]
    return functools.reduce(DataFrame.union, [_batch(rows, x, n, k, metric, id_col, vector_col, query_id) for x in of])


#: From so many queries on, comparing rows outweighs dealing them to all cores.
DEALT_FROM = 64


def _batch(rows: DataFrame, q: DataFrame, n: int, k: int, metric: str, id_col: str, vector_col: str, query_id: str) -> DataFrame:
    if metric not in V.METRICS:
        raise ValueError(f"metric {metric!r} is none of {V.METRICS}")
    spark = rows.sparkSession
    asked = q.where(~F.exists("q_v", lambda x: x.isNull())).select("q_id", "q_v").toArrow().combine_chunks()
    sizes = pc.list_value_length(asked["q_v"]).to_numpy()
    by_size = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        by_size[d] = at, pc.list_flatten(asked["q_v"].take(at)).to_numpy().reshape(len(at), d)
    sent = spark.sparkContext.broadcast((asked["q_id"].combine_chunks(), by_size))
    v = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    if n >= DEALT_FROM:
        v = v.repartition(spark.sparkContext.defaultParallelism)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, by_size = sent.value
        best = {d: Nearest(m, k, metric) for d, (_, m) in by_size.items()}
        kind = None
        for batch in batches:
            kind, lengths = batch.column(0).type, pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d, near in best.items():
                at = np.flatnonzero(lengths == d)
                if len(at):
                    own = batch.take(at) if len(at) < len(lengths) else batch
                    near.add(own.column(0).to_numpy(zero_copy_only=False), own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))
        for d, near in best.items():
            of, ids, far = near.found()
            for a in range(0, len(of), 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(by_size[d][0][of[part]])), pa.array(ids[part], kind), pa.array(far[part])], names=["q_id", "id", "distance"])

    schema = T.StructType([T.StructField("q_id", q.schema["q_id"].dataType), T.StructField("id", v.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    scored = v.mapInArrow(scan, schema).withColumnRenamed("q_id", query_id)
    w = Window.partitionBy(query_id).orderBy("distance", "id")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(query_id, F.col("rank").cast("int").alias("rank"), "id", "distance", V.score(F.col("distance")).alias("score"))


def index_shape(rows: int, dim: int) -> tuple[int, int]:
    """(partitions, sub-vectors): the root of the rows between 1 and 256; an
    eighth or sixteenth of the dimension, or 1."""
    parts = max(1, min(INDEX_MOST_PARTITIONS, int(rows**0.5 + 0.5)))
    return parts, dim // 16 if dim % 16 == 0 else dim // 8 if dim % 8 == 0 else 1


class InvertedFile:
    """k-means cells as a partition column: a search reads only the cells next to its query.

    ``write`` stores it in a folder per cell, so that choice is a static partition filter;
    a built index that is not written assigns its rows in every search.
    """

    def __init__(self, centroids: list[list[float]], cells: DataFrame, rows: int):
        self.centroids, self.cells, self.rows = centroids, cells, rows

    @classmethod
    def build(cls, rows: DataFrame, vector_col: str = "vector", partitions: int | None = None, sample: int = 50_000, seed: int = 1) -> InvertedFile | None:
        """None below ten thousand rows unless ``partitions`` is given, and without any vector.
        Centroids are fitted on a bounded sample; every row is assigned, in one pass without a
        shuffle. Rows without a vector, or with one of another dimension than the most
        frequent, have no cell."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        sizes = rows.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("dim")).count()
        most = sizes.orderBy(F.desc("count"), "dim").first()
        if most is None or partitions is None and most["count"] < INDEX_LEAST_ROWS:
            return None
        n, whole = most["count"], rows.where(F.size(vector_col) == most["dim"])
        if partitions is None:
            partitions = index_shape(n, 0)[0]
        fit = whole.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
        if n > sample:
            fit = fit.sample(sample / n, seed=seed)
        centers = [c.tolist() for c in KMeans(k=partitions, seed=seed, maxIter=50).fit(fit).clusterCenters()]
        return cls(centers, cls.assigned(rows, centers, vector_col), n)

    @staticmethod
    def assigned(rows: DataFrame, centers: list[list[float]], vector_col: str) -> DataFrame:
        """``rows`` with ``ivf_id``, the nearest centroid's number."""
        books, place, block = np.array(centers), rows.columns.index(vector_col), 4_096

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = batch.column(place).to_pylist()
                at = [k for k, x in enumerate(vectors) if x is not None and len(x) == books.shape[1] and None not in x]
                cells: list[int | None] = [None] * len(vectors)
                for k in range(0, len(at), block):
                    own = at[k : k + block]
                    x = np.array([vectors[i] for i in own], np.float64)
                    near = ((books * books).sum(1) - 2 * x @ books.T).argmin(1)
                    for i, c in zip(own, near.tolist(), strict=True):
                        cells[i] = c
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "ivf_id"])

        schema = rows.withColumn("ivf_id", F.lit(None).cast("int")).schema
        return rows.mapInArrow(assign, schema)

    def write(self, path: str, **notes: str) -> None:
        """A folder per cell below ``path``, large cells dealt over tasks; then the centroids
        with ``notes``: they are the mark of a complete index."""
        held = self.cells.where("ivf_id is not null")
        held.repartition("ivf_id", F.pmod(F.xxhash64(*held.columns), F.lit(8))).write.mode("overwrite").partitionBy("ivf_id").parquet(f"{path}/cells")
        spark = self.cells.sparkSession
        rows = [(k, c, self.rows, notes) for k, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, self._BOOK).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    _BOOK = "ivf_id int, centroid array<double>, rows long, notes map<string,string>"

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> InvertedFile:
        book = spark.read.schema(cls._BOOK).parquet(f"{path}/centroids").orderBy("ivf_id").collect()
        out = cls([r.centroid for r in book], spark.read.parquet(f"{path}/cells"), book[0].rows)
        out.notes = book[0].notes
        return out

    notes: dict[str, str] = {}

    def info(self) -> dict:
        """What an index is: its kind, distance, rows and cells."""
        return {"has_index": True, "index_type": "ivf", "distance_type": "l2", "chunk_count": self.rows, "num_partitions": len(self.centroids)}

    def search(self, query: Sequence[float], k: int = 10, probes: int = 8, **kw) -> DataFrame:
        """``top_k`` among the rows of the ``probes`` nearest cells; with all of them exact."""
        near = sorted(range(len(self.centroids)), key=lambda i: sum((a - b) ** 2 for a, b in zip(self.centroids[i], query, strict=True)))
        return top_k(self.cells.where(F.col("ivf_id").isin(near[:probes])), query, k, **kw)
