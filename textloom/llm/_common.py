"""What the training-data operators share: tables, shared storage, batches, ids."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_BYTES, BATCH_ROWS, bounded_batches, give_back, in_arrow  # noqa: F401

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, that driver and executors share; a
    folder of our own only where that setting is missing on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the
    lineage, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stashed[id(out)] = weakref.ref(out, lambda _, k=id(out): _stashed.pop(k, None)), path
    return out


_stashed: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stash`` wrote and nothing reads any more."""
    for t in tables:
        if found := _stashed.pop(id(t), None):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(found[1])
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_text(column: str) -> Column:
    """Unsigned crc32 of an id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def by_size(items: list, size, most: int) -> Iterator[tuple[int, list]]:
    """Consecutive runs of ``items`` with at most ``most`` bytes each (one item at least), with their place."""
    at, total = 0, 0
    for k, x in enumerate(items):
        n = size(x)
        if k > at and total + n > most:
            yield at, items[at:k]
            at, total = k, 0
        total += n
    if items[at:]:
        yield at, items[at:]


def bounded_sample(df: DataFrame, key: str, most: int, n: int | None = None) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``. The hash first
    thins the rows where they lie, so the final sort sees about twice ``most``."""
    n = df.count() if n is None else n
    h = F.xxhash64(key)
    if n > 2 * most:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * most / n))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), key).limit(most)


ID_BUCKETS = 1 << 20


def by_ids(rows: DataFrame, ids: DataFrame, column: str, inside: bool) -> DataFrame:
    """The rows whose id falls into a hash bucket of some id of ``ids`` (or those whose
    does not), without a shuffle of ``rows``: the buckets are broadcast, and however many
    ids there are, they are ``ID_BUCKETS`` numbers at most. Other ids may share a bucket,
    so an exact join has to follow on the few rows inside; with so many ids that every
    bucket is hit all rows are inside, and that join does all the work."""

    def bucket(c) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))

    hit = ids.select(bucket(F.col(column).cast("long")).alias("__bucket")).distinct()
    held = rows.select(F.struct("*").alias("__row"), bucket(F.col(column).cast("long")).alias("__bucket"))
    kept = held.join(F.broadcast(hit), "__bucket", "left_semi" if inside else "left_anti")
    return kept.select(*[F.col("__row")[c].alias(c) for c in rows.columns])
