"""Keyword index and search as tables: postings, document frequencies, lengths."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query import TermQuery, parse_terms, tokens_plain
from ..functions.text import terms

K1, B = 1.2, 0.75


@dataclass
class Index:
    """``postings`` (term, id, tf, dl) carry the document's length, so scoring a query
    touches the rows of its terms alone; ``totals`` is one row (n, avgdl). ``entries`` is
    a row (id, dl, terms) per document, where there still is one: what ``write`` stores."""

    postings: DataFrame
    totals: DataFrame
    entries: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Index:
        tokens = docs.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
        lengths = tokens.select("id", F.size("terms").cast("long").alias("dl"), "terms")
        # counted inside the row where it lies: the shuffle carries one row per different term
        postings = lengths.select("id", "dl", F.explode("terms").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
        totals = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return cls(postings.select("term", "id", "tf", "dl"), totals, lengths)

    _STORED = "term string, id string, no long, dl long, tf long"

    def write(self, path: str) -> None:
        """One pass that moves no row: a task's file holds its documents (no term; id, dl) and
        then their postings (term, tf) in the order of terms, so a query reads the pages of
        its terms. Both carry the document's number within the index, far smaller than its id."""
        if self.entries is not None:
            # each text's terms are counted in its row: in order, equal ones form runs
            rows = self.entries.select("id", "dl", F.sort_array("terms").alias("ts"))
            rows = rows.select("*", F.array_compact(F.transform("ts", lambda t, i: F.when((i == 0) | (t != F.get("ts", i - 1)), i))).alias("at"))
            counts = F.transform("at", lambda i, k: F.struct(F.get("ts", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("ts")) - i).cast("long").alias("tf")))
            rows = rows.select("id", "dl", counts.alias("counts"))
        else:
            rows = self.postings.groupBy("id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("counts"))
        own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("tf")))
        rows = rows.select(F.col("id").cast("string").alias("id"), "dl", F.monotonically_increasing_id().alias("no"), F.concat(own, "counts").alias("counts"))
        rows = rows.select("id", "dl", "no", F.explode("counts").alias("c"))  # numbered before it becomes many rows
        first = F.col("c.term").isNull()
        rows = rows.select("c.term", F.when(first, F.col("id")).alias("id"), "no", F.when(first, F.col("dl")).alias("dl"), "c.tf")
        rows.sortWithinPartitions("term", "no").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/entries")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        """Conditions on terms reach the files: they pass the sum, which brings rows of a
        repeated id together as ``of`` does, and the join."""
        rows = spark.read.schema(cls._STORED).parquet(f"{path}/entries")
        docs = rows.where("term is null").select("no", "id", "dl")
        postings = rows.where("term is not null").select("term", "no", "tf").join(docs, "no").groupBy("term", "id", "dl").agg(F.sum("tf").alias("tf"))
        return cls(postings.select("term", "id", "tf", "dl"), docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))

    def hits(self, words: list[str]) -> DataFrame:
        rows = self.postings.where(F.col("term").isin(words)) if words else self.postings.limit(0)
        return rows.select("term", "id", "tf", "dl")

    def remove(self, ids: DataFrame) -> Index:
        kept = self.postings.join(ids, "id", "left_anti")
        docs = kept.groupBy("id").agg(F.max("dl").alias("dl"))
        return Index(kept, docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def _with_df(hits: DataFrame) -> DataFrame:
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row per query term
    return hits.join(F.broadcast(df), "term")


def tfidf_scores(index: Index, query: str) -> DataFrame:
    """(id, score > 0): the sum over the query's words, repeats included, of tf * (1 + ln(n / (1 + df)))."""
    words = tokens_plain(query)
    hits = _with_df(index.hits(sorted(set(words)))).join(F.broadcast(index.totals))
    times = {w: words.count(w) for w in words}
    weight = F.lit(1)
    for w, n in times.items():
        if n > 1:
            weight = F.when(F.col("term") == w, n).otherwise(weight)
    part = F.col("tf") * (1.0 + F.log(F.col("n") / (1.0 + F.col("df")))) * weight
    return _summed(hits, part).where("score > 0")


def bm25_scores(index: Index, query: str | TermQuery, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score): Okapi BM25 over the query's words. Positive: larger is better."""
    q = parse_terms(query) if isinstance(query, str) else query
    hits = index.hits(sorted(set(q.positive)))
    for p in dict.fromkeys(q.prefixes):
        # all terms that begin so count as one
        begins = index.postings.where(F.col("term").startswith(p)).groupBy("id", "dl").agg(F.sum("tf").alias("tf"))
        hits = hits.union(begins.select(F.lit(f"{p}*").alias("term"), "id", "tf", "dl"))
    hits = _with_df(hits).join(F.broadcast(index.totals))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    tf = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    return _summed(hits, idf * tf)


def _summed(hits: DataFrame, part: Column) -> DataFrame:
    """Sums each id's parts in the order of terms, so that no plan changes a score's last bits."""
    parts = hits.select("id", F.struct("term", part.alias("x")).alias("p")).groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return parts.select("id", F.aggregate("ps", F.lit(0.0), lambda a, p: a + p["x"]).alias("score"))


def matching(index: Index, query: str | TermQuery, docs: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Ids that satisfy a keyword query. Phrases and NEAR need the texts (``docs``)."""
    q = parse_terms(query) if isinstance(query, str) else query
    wanted = index.hits(sorted(set(q.positive) | set(q.never)))
    flags = [F.max((F.col("term") == w).cast("int")).alias(f"w{k}") for k, w in enumerate(q.must)]
    flags += [F.max(F.col("term").isin(list(g)).cast("int")).alias(f"g{k}") for k, g in enumerate(q.any_of)]
    words_of = [*(p for ps in q.phrases for p in ps), *(x for a, b, _ in q.near for x in (a, b))]
    flags += [F.max((F.col("term") == w).cast("int")).alias(f"p{k}") for k, w in enumerate(words_of)]
    flags += [F.max(F.col("term").isin(list(q.never)).cast("int")).alias("never")] if q.never else []
    if q.prefixes:
        begins = F.lit(False)
        for p in q.prefixes:
            begins = begins | F.col("term").startswith(p)
        wanted = wanted.union(index.postings.select("term", "id", "tf", "dl").where(begins))
        flags += [F.max(F.col("term").startswith(p).cast("int")).alias(f"b{k}") for k, p in enumerate(q.prefixes)]
    if not flags:
        return index.postings.select("id").limit(0)
    by = wanted.groupBy("id").agg(*flags)
    keep = F.lit(True)
    for c in by.columns[1:]:
        keep = keep & ((F.col(c) == 0) if c == "never" else (F.col(c) == 1))
    ids = by.where(keep).select("id")
    if (q.phrases or q.near) and docs is not None:
        held = docs.select(F.col(id_col).alias("id"), terms(text_col).alias("terms")).join(ids, "id", "left_semi")
        text = F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" "))
        keep = F.lit(True)
        for p in q.phrases:
            keep = keep & text.contains(f" {' '.join(p)} ")
        for a, b, n in q.near:
            keep = keep & _near(a, b, n)
        ids = held.where(keep).select("id")
    return ids


def _near(a: str, b: str, n: int) -> Column:
    """At most ``n`` other words lie between some occurrence of either."""

    def places(w: str) -> Column:
        return F.filter(F.transform("terms", lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull())

    return F.exists(places(a), lambda i: F.exists(places(b), lambda j: F.abs(i - j) <= n + 1))


def ranked(scores: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """The k best with their rank from 1, ties to smaller ids. The limit comes first, so
    the ranking window holds k rows."""
    top = scores.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("int"))


def search(docs: DataFrame, query: str, k: int = 10, scorer: str = "bm25", index: Index | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, score, rank). A blank query finds nothing. With an index its postings are read,
    without one the texts."""
    if index is None:
        return ranked(_scanned(docs, query, scorer, id_col, text_col), k)
    if scorer == "tfidf":
        return ranked(tfidf_scores(index, query), k)
    q = parse_terms(query)
    return ranked(bm25_scores(index, q).join(matching(index, q, docs, id_col, text_col), "id", "left_semi"), k)


def _scanned(docs: DataFrame, query: str, scorer: str, id_col: str, text_col: str, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) without an index: each text counts the query's words where it lies. One
    aggregate gives the corpus's numbers, which are one row; no text and no posting moves."""
    q = TermQuery(must=tuple(dict.fromkeys(tokens_plain(query)))) if scorer == "tfidf" else parse_terms(query)
    words = [*sorted(set(q.positive)), *dict.fromkeys(q.prefixes)]
    starts = len(set(q.positive))
    text_of = F.coalesce(F.col(text_col), F.lit(""))

    def times(w: str, begins: bool = False) -> Column:
        n = F.size(F.filter("terms", lambda t: t.startswith(w))) if begins else F.size("terms") - F.size(F.array_remove("terms", w))
        return n.cast("long")

    def counts(of: DataFrame) -> DataFrame:
        rows = of.select(F.col(id_col).alias("id"), terms(text_of).alias("terms"))
        return rows.select("id", F.size("terms").cast("long").alias("dl"), *[times(w, k >= starts).alias(f"t{k}") for k, w in enumerate(words)], *([F.col("terms")] if q.phrases or q.near or q.never else []))

    counted = counts(docs)
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{k}") > 0).alias(f"d{k}") for k in range(len(words))])
    if not words:
        return counted.limit(0).select("id", F.lit(0.0).alias("score"))
    # a term lies in its text as it is, so texts without it need not be cut into terms again
    within = {w: F.contains(F.lower(text_of), F.lit(w)) for w in words}
    needed = [[w] for w in q.must] + [list(g) for g in q.any_of] + [[w] for w in words[starts:]]
    if scorer == "tfidf":
        needed = [words]
    for group in needed:
        docs = docs.where(functools.reduce(lambda a, c: a | c, [within[w] for w in group]))
    counted = counts(docs)
    has = {w: F.col(f"t{k}") > 0 for k, w in enumerate(words[:starts])}
    keep = F.lit(True)
    if scorer == "tfidf":
        keep = functools.reduce(lambda a, c: a | c, has.values())
    else:
        for w in q.must:
            keep = keep & has[w]
        for group in q.any_of:
            keep = keep & functools.reduce(lambda a, c: a | c, [has[w] for w in group])
        for k in range(starts, len(words)):
            keep = keep & (F.col(f"t{k}") > 0)
        if q.never:
            keep = keep & ~F.arrays_overlap("terms", F.array(*map(F.lit, q.never)))
        text = F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" ")) if q.phrases else None
        for p in q.phrases:
            keep = keep & text.contains(f" {' '.join(p)} ")
        for x, y, n in q.near:
            keep = keep & _near(x, y, n)
    # terms are added in their order
    order = sorted(range(len(words)), key=lambda k: words[k] + "*" * (k >= starts))
    plain = tokens_plain(query)
    score = F.lit(0.0)
    for k in order:
        tf, df = F.col(f"t{k}"), F.col(f"d{k}")
        if scorer == "tfidf":
            part = tf * (1.0 + F.log(F.col("n") / (1.0 + df))) * plain.count(words[k])
        else:
            idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
            part = idf * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))))
        score = score + F.when(tf > 0, part).otherwise(0.0)
    # the condition waits for the corpus's numbers: below, it would cut each text into terms once more
    keep = keep & (F.col("n") > 0) if scorer != "tfidf" else keep & (score > 0)
    return counted.join(F.broadcast(totals)).where(F.when(keep, F.col("n")) > 0).select("id", score.alias("score"))


def substring_search(docs: DataFrame, query: str, k: int = 10, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Texts that contain the query, ASCII case aside, all of score 1; by id."""
    return docs.where(F.lower(F.col(text_col)).contains(query.lower())).select(F.col(id_col).alias("id"), F.lit(1.0).alias("score")).orderBy("id").limit(k)


def minmax(scores: DataFrame, col: str = "score", negate: bool = False) -> DataFrame:
    """Scores scaled to 0..1. All equal: 1 if above zero (negated scores: always), else 0.
    The extremes are one aggregated row, so no window holds all rows."""
    x = -F.col(col) if negate else F.col(col)
    ends = scores.agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    flat = F.when(F.lit(negate) | (F.col("__high") > 0), 1.0).otherwise(0.0)
    out = F.when(F.col("__high") == F.col("__low"), flat).otherwise((x - F.col("__low")) / (F.col("__high") - F.col("__low")))
    return scores.join(F.broadcast(ends)).withColumn(col, out).drop("__low", "__high")


def scorer_for(files: int, preference: str = "auto", native_from: int = 5_000) -> str:
    """tfidf or bm25: ``auto`` takes bm25 above five thousand files."""
    return {"js": "tfidf", "native": "bm25"}.get(preference) or ("bm25" if files > native_from else "tfidf")


def upsert(docs: DataFrame, changes: DataFrame, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """``docs`` with each changed id's latest row (largest ``seq_col``); null text deletes."""
    w = Window.partitionBy(id_col).orderBy(F.desc(seq_col))
    last = changes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    new = last.where("text is not null").select(*docs.columns)
    return docs.join(last.select(id_col), id_col, "left_anti").select(*docs.columns).unionByName(new)
