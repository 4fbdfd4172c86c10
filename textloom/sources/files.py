"""Files as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy as P
from ..operators.paths import safe

DOCS = r"(?i)\.(?:md|txt)$"
CODE = r"(?i)\.(?:ts|tsx|js|jsx|mjs|cjs|py|java|go|rs|c|h|cpp|hpp|cs|rb)$"


LISTED = "path string, is_dir boolean, length long, modified timestamp"


def _uri(root: str) -> str:
    return root.rstrip("/") if "://" in root or root.startswith("file:") else f"file://{root.rstrip('/')}"


def _lister(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for i in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                    if not (store.type_name == "local" and os.path.islink(i.path)):
                        rows.append((f"{folder}/{i.base_name}".lstrip("/"), i.type == fs.FileType.Directory, i.size or 0, i.mtime))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "is_dir", "length", "modified"])

    return run


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                with store.open_input_stream(f"{base}/{path}") as f:
                    content = f.read()
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], names=["path", "length", "modified", "content"])

    return run


def listing(spark: SparkSession, root: str, prune: bool = True, depth: int = 64) -> DataFrame:
    """(path, length, modified) of all files below ``root``, dotfiles included (which
    Spark's own file sources pass over), links left out. Level by level, each level's
    folders listed by tasks; with ``prune`` folders that the policy never takes are
    not entered. A folder that cannot be listed fails the job: it is never taken for
    an empty one.
    """
    uri = _uri(root)
    level = spark.createDataFrame([("",)], "path string")
    found = None
    for _ in range(depth):
        inside = level.mapInArrow(_lister(uri), LISTED).persist()
        rows = inside.where("not is_dir").select("path", "length", "modified")
        found = rows if found is None else found.union(rows)
        folders = inside.where("is_dir").select("path")
        level = folders.where(~P.hard_denied(F.concat("path", F.lit("/x")))) if prune else folders
        if not level.take(1):
            return found
        level = level.repartition(max(1, min(1024, level.count() // 64)))
    raise ValueError(f"folders lie deeper than {depth} levels")


def _classified(spark: SparkSession, root: str, policy: P.Policy) -> DataFrame:
    """Listed files with the rule that leaves them out. Contents are read only of files
    that the rules on path and size leave."""
    listed = P.classify(listing(spark, root).where(safe("path")), policy, size="length")
    read = listed.where("should_index").select("path", "length", "modified").mapInArrow(_reader(_uri(root)), "path string, length long, modified timestamp, content binary")
    read = P.classify(read, policy, size="length", content="content")
    return listed.where("not should_index").withColumn("content", F.lit(None).cast("binary")).unionByName(read)


def scan(spark: SparkSession, root: str, policy: P.Policy = P.Policy(), max_files: int | None = None) -> DataFrame:
    """(path, text, length, modified, content_hash) of the files below ``root`` that the
    policy takes, with paths relative to it. ``max_files`` is an error when exceeded, not a cap."""
    found = _classified(spark, root, policy).where("should_index")
    if max_files is not None and (n := found.count()) > max_files:
        raise ValueError(f"{n} files, {max_files} at most")
    return found.select("path", F.decode("content", "UTF-8").alias("text"), "length", "modified", F.sha2("content", 256).alias("content_hash"))


def report(spark: SparkSession, root: str, policy: P.Policy = P.Policy()) -> DataFrame:
    """(category, files): how many files each rule leaves out; null is indexed. Folders
    that are never entered are not counted."""
    return _classified(spark, root, policy).groupBy("category").agg(F.count("*").alias("files"))


def gitignores(spark: SparkSession, root: str, depth: int = 20) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Rules of all .gitignore files below ``root``, outer ones first: few and small."""
    own = listing(spark, root).where(F.col("path").rlike(r"(?:^|/)\.gitignore$"))
    rows = own.mapInArrow(_reader(_uri(root)), "path string, length long, modified timestamp, content binary").select("path", F.decode("content", "UTF-8").alias("text")).collect()
    found = [(r.path.rpartition("/")[0], tuple(r.text.split("\n"))) for r in rows if r.path.count("/") <= depth]
    return tuple(sorted(found, key=lambda x: (x[0].count("/") + bool(x[0]), x[0])))


def documents(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(DOCS))


def code(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(CODE))


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", F.col("content_hash").alias("hash"))
