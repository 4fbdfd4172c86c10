"""Re-ranking of results by type, name, path, tags, docstring and length."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query import Intent, detect, entity_like, tokens, type_boosts
from ..functions.text import identifier_tokens

# Other names of chunk types, name boosts by share of query tokens, path, docstring and length factors.
TYPE_ALIASES = {
    "func": "function", "fn": "function", "def": "function", "meth": "method", "cls": "class", "struct": "class",
    "interface": "class", "trait": "class", "type": "class", "mod": "module", "pkg": "module", "package": "module",
}
NAME_EXACT, NAME_TIERS = 1.4, ((0.8, 1.3), (0.5, 1.2), (0.3, 1.1))
NAME_ANY = 1.05
PATH_STEP, PATH_MOST = 0.05, 1.2
DOCSTRING, MODULE_SHARE = 1.05, 0.4
LENGTHS = ((4000, 0.95), (2000, 0.98))
FACTORS = ("type_boost", "name_boost", "path_boost", "tag_boost", "docstring_bonus", "length_penalty")


@dataclass(frozen=True)
class Weights:
    type_boost: float = 1.0
    name_boost: float = 1.0
    path_boost: float = 1.0
    tag_boost: float = 1.0
    docstring_bonus: float = 1.0
    length_penalty: float = 1.0


@dataclass(frozen=True)
class Config:
    enabled: bool = True
    weights: Weights = field(default_factory=Weights)
    docstring: float = DOCSTRING
    mild: int = 2000
    strong: int = 4000


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def type_boost(chunk_type: Column, boosts: dict[str, float]) -> Column:
    known = boosts | {a: boosts[t] for a, t in TYPE_ALIASES.items()}
    return F.coalesce(_map(known)[F.lower(chunk_type)], F.lit(boosts["other"]))


def _overlap(theirs: Column, ours: list[str]) -> Column:
    return F.coalesce(F.size(F.array_intersect(F.array(*map(F.lit, ours)), theirs)), F.lit(0)) if ours else F.lit(0)


def name_boost(name: Column, query: str, query_tokens: list[str], exact: float = NAME_EXACT) -> Column:
    ours = list(dict.fromkeys(query_tokens))
    if not ours:
        return F.lit(1.0)
    found = _overlap(identifier_tokens(name), ours)
    out = F.when(F.lower(name) == query.lower(), exact)
    for least, factor in NAME_TIERS:
        out = out.when(found / len(ours) >= least, factor)
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, 1.0).otherwise(out.when(found > 0, NAME_ANY).otherwise(1.0))


def path_boost(path: Column, query_tokens: list[str]) -> Column:
    ours = list(dict.fromkeys(query_tokens))
    parts = identifier_tokens(F.regexp_replace(path, r"[\\/.]", " "))
    return F.coalesce(F.least(F.lit(1.0) + _overlap(parts, ours) * PATH_STEP, F.lit(PATH_MOST)), F.lit(1.0))


def tag_boost(tags: Column, intent: Intent) -> Column:
    names = [m.category.lower() for m in intent.matches]
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    return F.lit(1.0) + _overlap(low, names) * 0.1


def docstring_bonus(doc: Column, chunk_type: Column, entity: bool, bonus: float = DOCSTRING) -> Column:
    blank = doc.isNull() | (F.trim(doc) == "")
    module = F.lower(F.coalesce(chunk_type, F.lit(""))) == "module"
    return F.when(blank, 1.0).when(module & F.lit(entity), 1.0 + (bonus - 1.0) * MODULE_SHARE).otherwise(bonus)


def length_penalty(text: Column, mild: int = 2000, strong: int = 4000) -> Column:
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n > strong, LENGTHS[0][1]).when(n > mild, LENGTHS[1][1]).otherwise(1.0)


def rank(results: DataFrame, query: str, config: Config = Config()) -> DataFrame:
    """``results`` (id, score, text, path, chunk_type, chunk_name, chunk_tags,
    chunk_docstring) with each factor and ``final_score``, best first, ties as they ranked
    before. Disabled: as it is, every factor 1. All in one projection."""
    if not config.enabled:
        return results.select("*", *[F.lit(1.0).alias(f) for f in FACTORS], F.col("score").alias("final_score"))
    intent, ours = detect(query), tokens(query)
    w = config.weights
    out = results.select(
        "*",
        type_boost(F.col("chunk_type"), type_boosts(intent)).alias("type_boost"),
        name_boost(F.col("chunk_name"), query, ours).alias("name_boost"),
        path_boost(F.col("path"), ours).alias("path_boost"),
        tag_boost(F.col("chunk_tags"), intent).alias("tag_boost"),
        docstring_bonus(F.col("chunk_docstring"), F.col("chunk_type"), entity_like(query, ours), config.docstring).alias("docstring_bonus"),
        length_penalty(F.col("text"), config.mild, config.strong).alias("length_penalty"),
    )
    final = F.col("score")
    for f in FACTORS:
        weight = getattr(w, f)
        if weight:
            final = final * (F.col(f) if weight == 1.0 else F.pow(F.col(f), F.lit(weight)))
    return out.withColumn("final_score", final).orderBy(F.desc("final_score"), F.desc("score"), "id")


def intent_boosted(results: DataFrame, query: str) -> DataFrame:
    """score times type, tag and name boosts, where a name never counts as exact; without intents as it is."""
    intent = detect(query)
    if not intent.matches:
        return results
    boost = type_boost(F.col("chunk_type"), type_boosts(intent)) * tag_boost(F.col("chunk_tags"), intent)
    ours = list(dict.fromkeys(intent.tokens))
    found = _overlap(identifier_tokens(F.coalesce("chunk_name", F.lit(""))), ours) / max(len(ours), 1)
    name = F.when(found >= 0.8, 1.4).when(found >= 0.5, 1.2).when(found >= 0.3, 1.1).when(found > 0, 1.05).otherwise(1.0)
    return results.withColumn("score", F.col("score") * boost * name).orderBy(F.desc("score"), "id")


def statistics(ranked: DataFrame) -> DataFrame:
    """One row: average, least and largest of each factor, mean and largest relative
    change of score, and the number of positions that another id holds now.

    Results are a top-k list: the two ranking windows hold k rows."""
    was = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    now = F.row_number().over(Window.orderBy(F.desc("final_score"), F.desc("score"), "id"))
    placed = ranked.select("*", was.alias("__was"), now.alias("__now"), F.when(F.col("score") != 0, F.col("final_score") / F.col("score") - 1.0).otherwise(0.0).alias("__gain"))
    parts = [g(f).alias(f"{n}_{f}") for f in FACTORS for n, g in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return placed.agg(*parts, F.avg("__gain").alias("avg_improvement"), F.max(F.abs("__gain")).alias("max_improvement"), F.count_if(F.col("__was") != F.col("__now")).alias("reordered"))
