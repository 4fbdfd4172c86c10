"""The chunk table on disk: Parquet in buckets by path, so that a change rewrites the
buckets it touches and nothing else; and JSON sidecars."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class ChunkStore:
    """Each bucket lies in a folder of the version that wrote it last; ``current.json`` names
    the folder of every bucket. A change writes the buckets it touches into a new version, then
    a new pointer beside the old one, and renames it over that: a job that dies half-way leaves
    the table as it was. Folders that one pointer has let go are deleted with the next change,
    so readers of the version before still find theirs."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _pointer(self) -> str:
        return f"{self.root}/current.json"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs(self._pointer())
        return fs.exists(p)

    def _current(self) -> dict:
        return json.loads(self.spark.read.text(self._pointer(), wholetext=True).first()[0])

    def version(self) -> str:
        return self._current()["version"]

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        return {int(b): f"{v}/bucket={b}" for b, v in self._current()["buckets"].items()}

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets, or all; a table without rows has no file to tell its schema."""
        now = self._current()
        schema = T.StructType.fromJson(now["schema"])
        dirs = [f"{self.root}/{v}/bucket={b}" for b, v in now["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._rows()

    def _point(self, now: dict) -> None:
        jvm = self.spark._jvm
        fs, own = self._fs(f"{self._pointer()}.{uuid.uuid4().hex}")
        out = fs.create(own)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        target = jvm.org.apache.hadoop.fs.Path(self._pointer())
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(own), fs.makeQualified(target), options)

    def _put(self, rows: DataFrame, touched: set[int] | None) -> None:
        """``rows`` become the whole of the ``touched`` buckets (None: of all)."""
        before = self._current() if self.exists() else {"buckets": {}, "gone": []}
        name = f"v-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{name}")
        fs, p = self._fs(f"{self.root}/{name}")
        new = {f.getPath().getName().removeprefix("bucket="): name for f in fs.listStatus(p) if f.getPath().getName().startswith("bucket=")}
        kept = {} if touched is None else {b: v for b, v in before["buckets"].items() if int(b) not in touched}
        gone = [f"{v}/bucket={b}" for b, v in before["buckets"].items() if b not in kept]
        self._point({"version": name, "schema": rows.schema.jsonValue(), "buckets": kept | new, "gone": gone})
        for x in before["gone"]:
            _, p = self._fs(f"{self.root}/{x}")
            fs.delete(p, True)

    def write(self, chunks: DataFrame) -> None:
        """Replace the whole table."""
        self._put(chunks, None)

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _touched(self, *tables: DataFrame) -> set[int]:
        """Buckets of the paths of some tables: numbers below ``buckets``, so few."""
        paths = functools.reduce(DataFrame.union, [t.select("path") for t in tables])
        return {r[0] for r in paths.select(self._bucket().alias("b")).distinct().collect()}

    def append(self, chunks: DataFrame) -> None:
        """Rows of new paths join those of their buckets in one new version."""
        if not self.exists():
            return self.write(chunks)
        touched = self._touched(chunks)
        self._put(self._rows(sorted(touched)).unionByName(chunks, allowMissingColumns=True), touched)

    def replace_paths(self, paths: DataFrame, chunks: DataFrame) -> None:
        """Delete the chunks of ``paths`` and add ``chunks`` in one new version of the buckets
        that hold either."""
        touched = self._touched(paths, chunks)
        if touched:
            kept = self._rows(sorted(touched)).join(paths.select("path").distinct(), "path", "left_anti")
            self._put(kept.unionByName(chunks, allowMissingColumns=True), touched)

    def delete_paths(self, paths: list[str]) -> int:
        """Returns the number of chunks that went."""
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        touched = self._touched(named)
        now = self._rows(sorted(touched))
        gone = now.where(F.col("path").isin(paths)).count()
        if gone:
            self._put(now.where(~F.col("path").isin(paths)), touched)
        return gone

    def delete_ids(self, ids: DataFrame) -> None:
        held = self.read().join(ids.select("id"), "id", "left_semi")
        touched = self._touched(held)
        if touched:
            self._put(self._rows(sorted(touched)).join(ids.select("id"), "id", "left_anti"), touched)

    def drop(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)

    # reads

    def files(self, limit: int | None = None) -> DataFrame:
        found = self.read().select("path").distinct().orderBy("path")
        return found.limit(limit) if limit else found

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return lookup(self.read(), ids)

    def of_path(self, path: str) -> DataFrame:
        """One file's chunks: one bucket's files are read."""
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(path)), F.lit(self.buckets)).cast("int")).first()[0]
        return self._rows([bucket]).where(F.col("path") == path)

    def counts(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files"))

    def size(self) -> int:
        total = 0
        for x in self.folders().values():
            fs, p = self._fs(f"{self.root}/{x}")
            total += fs.getContentSummary(p).getLength()
        return total

    def has_data(self) -> bool:
        return self.exists() and bool(self.read().limit(1).count())


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; on one machine
    without that setting, as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return f"{root.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Path, text and span of some ids. The list of ids is the small side: Spark
    broadcasts it if its size allows and sorts otherwise."""
    return chunks.join(ids.select("id").distinct(), "id").select("id", "path", "text", "start_line", "end_line")


def write_json(df: DataFrame, path: str) -> None:
    """A sidecar (metadata, fingerprints, dirty set): one committed write."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
