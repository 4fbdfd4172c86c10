"""Search results: trimming, merging of line ranges of one file, compact form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed_lines


def trimmed(results: DataFrame) -> DataFrame:
    """Blank lines at the edges of texts go; line numbers stay as they are."""
    return results.withColumn("text", trimmed_lines("text"))


def _stitch(a: Column, x: Column) -> Column:
    """Joins the next range's text: behind a line feed if adjacent; without its first
    overlapping lines if it goes further; not at all if contained."""
    overlap = a["end_line"] - x["start_line"] + 1
    lines = F.split(x["text"], "\n")
    rest = F.array_join(F.slice(lines, overlap + 1, F.greatest(F.size(lines) - overlap, F.lit(0))), "\n")
    longer = F.when(overlap <= 0, F.concat(a["text"], F.lit("\n"), x["text"])).otherwise(F.when(F.size(lines) > overlap, F.concat(a["text"], F.lit("\n"), rest)).otherwise(a["text"]))
    return F.struct(F.when(x["end_line"] <= a["end_line"], a["text"]).otherwise(longer).alias("text"), F.greatest(a["end_line"], x["end_line"]).alias("end_line"))


def merged(results: DataFrame, gap: int = 1) -> DataFrame:
    """Ranges of one path that overlap or lie at most ``gap`` lines apart as one row:
    path, start_line, end_line, score (the best), text (stitched), parts; best first.

    Gaps and islands: one window by path marks islands; each is folded in line order."""
    by_path = Window.partitionBy("path").orderBy("start_line", "end_line", "id")
    reach = F.max("end_line").over(by_path.rowsBetween(Window.unboundedPreceding, -1))
    marked = results.withColumn("__new", (reach.isNull() | (F.col("start_line") > reach + gap)).cast("int"))
    islands = marked.withColumn("__island", F.sum("__new").over(by_path))
    held = islands.groupBy("path", "__island").agg(
        F.min("start_line").alias("start_line"), F.max("score").alias("score"), F.count("*").alias("parts"),
        F.array_sort(F.collect_list(F.struct("start_line", "end_line", "id", "text"))).alias("xs"),
    )
    first = F.struct(F.col("xs")[0]["text"].alias("text"), F.col("xs")[0]["end_line"].alias("end_line"))
    fold = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(1))), first, _stitch)
    folded = held.withColumn("__f", F.when(F.col("parts") == 1, first).otherwise(fold))
    return folded.select("path", "start_line", F.col("__f.end_line").alias("end_line"), "score", F.col("__f.text").alias("text"), "parts", F.col("xs")[0]["id"].alias("id")).orderBy(F.desc("score"), "path", "start_line")


def processed(results: DataFrame) -> DataFrame:
    return merged(trimmed(results))


def compact(results: DataFrame) -> DataFrame:
    """l "path:first-last", t text, s score at two digits."""
    return results.select(F.format_string("%s:%d-%d", "path", "start_line", "end_line").alias("l"), F.col("text").alias("t"), (F.floor(F.col("score") * 100 + 0.5) / 100).alias("s"))
