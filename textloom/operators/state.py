"""The corpus over time: fingerprint deltas, drift, chunk diffs, applying deltas,
Merkle hashes and diffs, and the dirty set. Joins and aggregates on equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_hash

ADDED, MODIFIED, REMOVED, UNCHANGED, MOVED, UNREADABLE = "added", "modified", "removed", "unchanged", "moved", "unreadable"


def fingerprint_delta(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status, old_hash, new_hash) of two tables (path, hash): a full outer join.
    A current path whose hash is null could not be read: its own status, never a removal."""
    old = stored.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("__old"))
    new = current.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("__new"))
    status = (
        F.when(F.col("__new").isNull(), REMOVED).when(F.col("new_hash").isNull(), UNREADABLE).when(F.col("__old").isNull(), ADDED)
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), UNCHANGED).otherwise(MODIFIED)
    )
    return old.join(new, "path", "full_outer").select("path", status.alias("status"), "old_hash", "new_hash")


def drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(status, files) counts."""
    return fingerprint_delta(stored, current).groupBy("status").agg(F.count("*").alias("files"))


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, chunk_hash, status, old_id, new_start, new_end): chunks (path, text,
    start_line, end_line, and id of old ones) matched as multisets by content: the n-th
    of equal chunks with the n-th, in line order. Equal spans are unchanged, others moved."""
    w = Window.partitionBy("path", "chunk_hash").orderBy("start_line", "end_line")

    def numbered(rows: DataFrame) -> DataFrame:
        hashed = rows if "chunk_hash" in rows.columns else rows.withColumn("chunk_hash", chunk_hash("text"))
        return hashed.withColumn("n", F.row_number().over(w))

    a = numbered(old).select("path", "chunk_hash", "n", F.col("id").alias("old_id"), F.col("start_line").alias("old_start"), F.col("end_line").alias("old_end"))
    b = numbered(new).select("path", "chunk_hash", "n", F.col("start_line").alias("new_start"), F.col("end_line").alias("new_end"))
    same = (F.col("old_start") == F.col("new_start")) & (F.col("old_end") == F.col("new_end"))
    status = F.when(F.col("old_start").isNull(), ADDED).when(F.col("new_start").isNull(), REMOVED).when(same, UNCHANGED).otherwise(MOVED)
    return a.join(b, ["path", "chunk_hash", "n"], "full_outer").select("path", "chunk_hash", status.alias("status"), "old_id", "old_start", "old_end", "new_start", "new_end")


def diff_summary(diff: DataFrame) -> DataFrame:
    """By path: counts of each status, chunks saved from embedding, and whether an
    update by chunks pays (more than half of the new ones saved; at least a quarter and
    three old ones is worth trying)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (ADDED, REMOVED, MOVED, UNCHANGED)]
    by = diff.groupBy("path").agg(*counts)
    saved, new, old = F.col(MOVED) + F.col(UNCHANGED), F.col(ADDED) + F.col(MOVED) + F.col(UNCHANGED), F.col(REMOVED) + F.col(MOVED) + F.col(UNCHANGED)
    return by.select("*", saved.alias("saved"), (saved > new / 2).alias("beneficial"), ((old >= 3) & (new > 0) & (saved >= new * 0.25)).alias("worthwhile"))


def apply_delta(chunks: DataFrame, delta: DataFrame, new_chunks: DataFrame, key: str = "path") -> DataFrame:
    """The chunk table after a delta (path, status): chunks of removed, modified and
    re-added paths go, ``new_chunks`` come in. Applying it again changes nothing."""
    gone = delta.where(F.col("status").isin(REMOVED, MODIFIED, ADDED)).select(key)
    return chunks.join(gone, key, "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def updated_spans(chunks: DataFrame, diff: DataFrame) -> DataFrame:
    """Chunks with the spans that a diff moved them to; the vectors stay."""
    moves = diff.where(F.col("status") == MOVED).select(F.col("old_id").alias("id"), F.col("new_start").alias("__s"), F.col("new_end").alias("__e"))
    out = chunks.join(moves, "id", "left")
    return out.withColumn("start_line", F.coalesce("__s", "start_line")).withColumn("end_line", F.coalesce("__e", "end_line")).select(*chunks.columns)


# Merkle hashes: of a chunk its span and text, of a file its chunks' in order, of a
# directory "name:hash" of its files by name, of the project "path:hash" of all files by path.


def merkle_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select("path", "start_line", "end_line", F.sha2(F.concat(F.col("start_line").cast("string"), F.lit(":"), F.col("end_line").cast("string"), F.lit(":"), F.col("text")), 256).alias("hash"), F.sha2("text", 256).alias("content_hash"))


def merkle_files(chunk_hashes: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "hash")))
    return chunk_hashes.groupBy("path").agg(parts.alias("p"), F.count("*").alias("chunks")).select("path", F.sha2(F.array_join(F.transform("p", lambda x: x["hash"]), ":"), 256).alias("hash"), "chunks")


def _children(name: Column, hash_: Column) -> Column:
    kids = F.array_sort(F.collect_list(F.struct(name.alias("n"), hash_.alias("h"))))
    return F.sha2(F.array_join(F.transform(kids, lambda x: F.concat(x["n"], F.lit(":"), x["h"])), "|"), 256)


def merkle_directories(files: DataFrame) -> DataFrame:
    """One row per directory that holds files ('' is the root): hash of its files."""
    parts = files.select("hash", F.regexp_extract("path", "^(.*)/", 1).alias("directory"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return parts.groupBy("directory").agg(_children(F.col("name"), F.col("hash")).alias("hash"), F.count("*").alias("files"))


def merkle_root(files: DataFrame) -> DataFrame:
    """One row: the hash over every file's path and hash, and their number. The hash runs
    over all of them in order, so its last step sees a path and a hash of each file."""
    return files.agg(_children(F.col("path"), F.col("hash")).alias("hash"), F.count("*").alias("files"))


def merkle_diff(old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """(path, status) of two tables of file hashes, changed ones alone."""
    return fingerprint_delta(old_files.select("path", "hash"), new_files.select("path", "hash")).where(F.col("status") != UNCHANGED).select("path", "status")


def same_root(old_root: DataFrame, new_root: DataFrame) -> bool:
    """Two one-row tables: equal roots need no diff."""
    return old_root.first()["hash"] == new_root.first()["hash"]


def duplicate_chunks(chunk_hashes: DataFrame, least: int = 2) -> DataFrame:
    """(content_hash, copies, files) of contents found at least twice."""
    return chunk_hashes.groupBy("content_hash").agg(F.count("*").alias("copies"), F.count_distinct("path").alias("files")).where(F.col("copies") >= least)


DELETED = "__deleted__:"


def dirty_set(events: DataFrame, path: str = "path", op: str = "op", seq: str = "seq") -> DataFrame:
    """(path, op): each path's last operation, upsert or delete: an add cancels a delete
    and the other way round. Partial aggregation keeps a row per task and path."""
    kind = F.when(F.col(op).isin("unlink", "delete"), "delete").otherwise("upsert")
    return events.groupBy(F.col(path).alias("path")).agg(F.max_by(kind, F.col(seq)).alias("op"))


def dirty_strings(dirty: DataFrame) -> DataFrame:
    """The set as strings: a deletion is its path behind a marker."""
    return dirty.select(F.when(F.col("op") == "delete", F.concat(F.lit(DELETED), F.col("path"))).otherwise(F.col("path")).alias("entry"))
