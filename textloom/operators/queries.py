"""Query understanding for a table of queries: the same rules as
:mod:`textloom.functions.query`, as expressions over fixed tables held as literals, so
a row needs neither a join nor Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query import EXPANSIONS, INTENTS, MAX_EXPANSION_TERMS
from ..functions.text import identifier_tokens


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def expanded(queries: DataFrame, query: str = "query", most: int = MAX_EXPANSION_TERMS) -> DataFrame:
    """With ``terms`` (array) and ``expanded``: see ``functions.query.expand``."""
    known = F.create_map(*[x for word, terms in EXPANSIONS.items() for x in (F.lit(word), _strings(terms.split()))])
    trimmed = F.regexp_replace(F.col(query), r"^\s+|\s+$", "")
    words = F.split(F.lower(trimmed), r"\s+")
    found = F.flatten(F.transform(words, lambda w: F.coalesce(known[w], _strings([]))))
    terms = F.slice(F.array_distinct(F.filter(found, lambda t: ~F.array_contains(words, t))), 1, most)
    full = F.when(trimmed == "", F.col(query)).otherwise(F.concat_ws(" ", trimmed, F.array_join(F.col("terms"), " ")))
    return queries.withColumn("terms", terms).withColumn("expanded", F.when(F.size("terms") > 0, full).otherwise(F.when(trimmed == "", F.col(query)).otherwise(trimmed)))


def intents(queries: DataFrame, query: str = "query", least: float = 0.3, most: int = 3) -> DataFrame:
    """(query, rank, category, confidence): see ``functions.query.detect``."""
    low, tokens = F.lower(F.col(query)), F.col("__tokens")
    parts = []
    for place, (category, (words, patterns, base)) in enumerate(INTENTS.items()):
        keys = _strings([w.lower() for w in words.split()])
        hits = F.size(F.filter(keys, lambda k: F.array_contains(tokens, k) | F.regexp_like(low, F.concat(F.lit(r"\b"), k, F.lit(r"\b")))))
        matched = F.lit(False)
        for p in patterns:
            matched = matched | low.rlike(p if category == "class" else f"(?i){p}")
        sure = F.when(hits > 1, F.least(F.lit(1.0), F.lit(base) + F.lit(0.1) * (hits - 1))).otherwise(F.lit(base))
        sure = F.floor(F.when(matched, F.least(F.lit(1.0), sure + 0.15)).otherwise(sure) * 100 + 0.5) / 100
        parts.append(F.when((hits > 0) | matched, F.struct((-sure).alias("far"), F.lit(place).alias("place"), F.lit(category).alias("category"))))
    found = F.filter(F.array(*parts), lambda x: x.isNotNull() & (-x["far"] >= least))
    top = F.slice(F.array_sort(found), 1, most)
    rows = queries.withColumn("__tokens", identifier_tokens(query)).withColumn("__top", top)
    rows = rows.select(query, F.posexplode("__top").alias("pos", "x"))
    return rows.select(F.col(query).alias("query"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.category").alias("category"), (-F.col("x.far")).alias("confidence"))
