"""Splitters and extractors over tables: one Arrow pass, then rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import splitters, symbols
from ..functions.batches import bounded_batches, give_back, in_arrow
from ..functions.text import chunk_hash
from .paths import language, language_of


def _udf(function, returns: str):
    """Made when a session exists: the type is parsed by it."""
    return F.pandas_udf(function, returns)


def _pieces_of(path: pd.Series, text: pd.Series, strategy: pd.Series) -> pd.Series:
    give_back()  # of the batch before

    def of(p, t, s):
        try:
            found = splitters.chunks(t or "", p or "", language_of(p or ""), s)
        except splitters.TooManyChunks:
            return []  # the file stays out of the index; every other goes on
        return [(c.text, c.start_line, c.end_line, c.type, c.name, c.parent, c.signature, c.docstring, list(c.tags)) for c in found]

    names = ["text", "start_line", "end_line", "type", "name", "parent", "signature", "docstring", "tags"]
    return pd.Series([[dict(zip(names, row, strict=True)) for row in of(*x)] for x in zip(path, text, strategy, strict=True)])


def _summary_of(path: pd.Series, text: pd.Series) -> pd.DataFrame:
    give_back()  # of the batch before
    rows = []
    for p, t in zip(path, text, strict=True):
        s = symbols.summarize(t or "", language_of(p or ""))
        c = s.complexity() if s else None
        rows.append(
            {"functions": None, "classes": None, "imports": None, "exports": None, "total": None, "code": None, "blank": None, "comment": None, "decisions": None, "cyclomatic": None, "max_nesting": None, "avg": None, "score": None}
            if s is None
            else {
                "functions": [dict(zip(("name", "start_line", "end_line", "complexity", "nesting"), f, strict=True)) for f in s.functions],
                "classes": s.classes, "imports": s.imports, "exports": s.exports, "total": s.total, "code": s.code, "blank": s.blank, "comment": s.comment,
                "decisions": s.decisions, "cyclomatic": c["cyclomatic"], "max_nesting": c["max_nesting"], "avg": c["avg"], "score": c["score"],
            }
        )
    return pd.DataFrame(rows)


def _comments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, found = [], []
        for p, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            for c in symbols.comments(t or "", language_of(p or "")):
                paths.append(p)
                found.append((c.text, c.start_line, c.end_line, c.type, c.symbol, symbols.comment_text(c)))
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["of", "comment", "start_line", "end_line", "type", "symbol", "index_text"])


def chunk_id(path: Column, start: Column, hash_: Column, ordinal: Column) -> Column:
    """The same for the same chunk, however often a stage is computed again."""
    return F.sha2(F.concat_ws("\x01", path, start.cast("string"), hash_, ordinal.cast("string")), 256)


def chunked(files: DataFrame, strategy: str = "character", path: str = "path", text: str = "text") -> DataFrame:
    """Chunk rows of (path, text) files, without vectors. Null and empty texts have none."""
    bounded_batches(files.sparkSession)
    parts = files.select(F.col(path).alias("path"), F.sha2(text, 256).alias("content_hash"), language(path).alias("chunk_language"), F.posexplode(_udf(_pieces_of, schema.PIECES)(path, text, F.lit(strategy))).alias("ordinal", "c"))
    h = chunk_hash("c.text")
    return parts.select(
        chunk_id(F.col("path"), F.col("c.start_line"), h, F.col("ordinal")).alias("id"), "path", F.col("c.text").alias("text"),
        F.lit(None).cast("array<float>").alias("vector"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), "content_hash",
        h.alias("chunk_hash"), F.col("c.type").alias("chunk_type"), F.col("c.name").alias("chunk_name"), F.col("c.signature").alias("chunk_signature"),
        F.col("c.docstring").alias("chunk_docstring"), F.col("c.parent").alias("chunk_parent"), F.col("c.tags").alias("chunk_tags"), "chunk_language",
    )


def summarized(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    bounded_batches(files.sparkSession)
    return files.select(F.col(path).alias("path"), language(path).alias("language"), _udf(_summary_of, schema.SUMMARY)(path, text).alias("s")).select("path", "language", "s.*")


def comment_rows(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows for the documents' table: id comment:<path>:<line>:<hash>, path behind a marker."""
    bounded_batches(files.sparkSession)
    rows = in_arrow(files.select(path, text), _comments_of, "of string, comment string, start_line int, end_line int, type string, symbol string, index_text string")
    h = F.substring(F.sha2("comment", 256), 1, 8)
    return rows.select(
        F.concat_ws(":", F.lit("comment"), "of", F.col("start_line").cast("string"), h).alias("id"), F.concat(F.lit("[code-comment] "), "of").alias("path"),
        F.col("index_text").alias("text"), "start_line", "end_line", F.col("symbol").alias("chunk_name"), F.col("type").alias("chunk_type"), "of",
    )


def line_chunks(files: DataFrame, lines: int = 20, path: str = "path", text: str = "text") -> DataFrame:
    """Fixed runs of lines, with DataFrame functions alone: path, start_line, end_line, text."""
    all_lines = F.split(text, "\n")
    n = F.size(all_lines)
    starts = F.sequence(F.lit(0), n - 1, F.lit(lines))
    rows = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), all_lines.alias("ls"), F.explode(starts).alias("s"))
    part = F.slice("ls", F.col("s") + 1, F.lit(lines))
    return rows.select("path", (F.col("s") + 1).alias("start_line"), (F.col("s") + F.size(part)).alias("end_line"), F.array_join(part, "\n").alias("text"))


def line_counts(files: DataFrame, path: str = "path", text: str = "text", comment: str = r"^\s*(?://|#|/\*|\*)") -> DataFrame:
    """path, total, blank, comment, code; native: a line is a comment if it begins like one."""
    ls = F.split(text, "\n")
    rows = files.where(F.col(text).isNotNull()).select(F.col(path).alias("path"), F.size(ls).alias("total"), F.size(F.filter(ls, lambda x: F.trim(x) == "")).alias("blank"), F.size(F.filter(ls, lambda x: x.rlike(comment))).alias("comment"))
    return rows.withColumn("code", F.greatest(F.lit(0), F.col("total") - F.col("blank") - F.col("comment")))


def complexity(functions: DataFrame, path: str = "path") -> DataFrame:
    """From rows per function (path, complexity, nesting): sum, mean, deepest, score."""
    by = functions.groupBy(path).agg(F.sum("complexity").alias("cyclomatic"), F.avg("complexity").alias("mean"), F.max("nesting").alias("max_nesting"), F.count("*").alias("functions"))
    lost = F.lit(0)
    for key, col in (("total", "cyclomatic"), ("mean", "mean"), ("nesting", "max_nesting"), ("functions", "functions")):
        part = F.lit(0)
        for limit, points in reversed(symbols.PENALTIES[key]):
            part = F.when(F.col(col) > limit, points).otherwise(part)
        lost = lost + part
    return by.withColumn("score", F.greatest(F.lit(0), 100 - lost)).withColumn("avg", F.floor(F.col("mean") * 100 + 0.5) / 100).drop("mean")
