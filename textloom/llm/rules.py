"""Quality rules, line first.

Each line of a text (parted at \\n) is judged by itself, in this order:

* navigation: a quarter of its words or more, two at least, are separators
  (``| > » • · / -`` alone or repeated);
* punctuation: over half of its words end in two or more of ``! ? # * $ % & | < >``,
  or the line has fewer than five words and does not end like a sentence;
* boilerplate: at most twenty words, with a phrase of the list below that begins a word.

Lines that fail go. A document that so loses more than half of its words is
rejected; so is one that fails the base rules (fewer than fifty words, or over
half of its words in three-word windows found twice or more).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import bounded_batches, table, texts

SEPARATOR = r"[|>»•·/-]+"
NOISY = r"[!?#*$%&|<>]{2,}$"
SENTENCE_END = r"""[.!?…:;"'”’»)\]]$"""
BOILERPLATE = (
    r"\b(?:cookie|javascript|lorem ipsum|all rights reserved|privacy policy|terms of use|terms of service"
    r"|subscribe|newsletter|sign up\b|log in\b|click here|read more|share this|back to top)"
)
MIN_WORDS, LEAST_KEPT = 50, 0.5
_SYMBOLS = b"#*$%&|<>"
_separator, _noisy = re.compile(SEPARATOR), re.compile(NOISY)
_end, _boilerplate = re.compile(SENTENCE_END), re.compile(BOILERPLATE, re.ASCII)


def fails(line: str, words: list[str]) -> str | None:
    """The rule that a line with words fails, if any."""
    n = len(words)
    separators = sum(1 for w in words if _separator.fullmatch(w))
    if separators >= 2 and 4 * separators >= n:
        return "navigation"
    if 2 * sum(1 for w in words if w[-1] in "!?#*$%&|<>" and _noisy.search(w)) > n or n < 5 and not _end.search(words[-1]):
        return "punctuation"
    if n <= 20 and _boilerplate.search(line.lower()):
        return "boilerplate"
    return None


def clean(text: str) -> tuple[str, int]:
    """The text without its failing lines, and the number of words that they had."""
    kept, lost = [], 0
    for line in text.split("\n"):
        words = [w.decode() for w in line.encode().split()]
        if words and fails(line, words):
            lost += len(words)
        else:
            kept.append(line)
    return "\n".join(kept), lost


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more, first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    n, reach = 0, -1
    for k, w in enumerate(windows):
        if count[w] > 1:
            n += k + 3 - max(k, reach)
            reach = k + 3
    return n


def _chars(text: str) -> int:
    return len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(words), _chars(text), len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the five measures, lost_words, base_failed,
    kept, and clean_text (null where not kept).

    A null or empty text has no words: base_failed, not kept. Repeated rows stay
    rows; a null doc_id stays null. Extra columns are not read.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, base_failed boolean, kept boolean, clean_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in texts(batch, "text"):
                n, _, symbols, dup, rep = m = measures(t)
                failed = n < MIN_WORDS or 100 * rep > 50 * n
                left, lost = clean(t)
                kept = not failed and lost <= (1 - LEAST_KEPT) * n
                rows.append((*m, lost, failed, kept, left if kept else None))
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[c.split()[0] for c in schema.split(", ")])

    return docs.selectExpr("doc_id", f"`{text}` AS text").mapInArrow(run, schema)


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict; see ``judge`` for nulls, empty texts and repeated rows."""
    return judge(table(spark, sf_dir, "documents")).drop("clean_text")


#: The same in SQL. Words are numbered, so a repeated window marks its three words.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
k AS (SELECT rid, line, len(w) AS n,
        len(list_filter(w, lambda x: regexp_full_match(x, '[|>»•·/-]+'))) AS seps,
        len(list_filter(w, lambda x: regexp_matches(x, '[!?#*$%&|<>]{2,}$'))) AS noisy,
        regexp_matches(w[-1], '[.!?…:;"''”’»)\]]$') AS ends,
        regexp_matches(lower(line), '\b(?:cookie|javascript|lorem ipsum|all rights reserved|privacy policy|terms of use|terms of service|subscribe|newsletter|sign up\b|log in\b|click here|read more|share this|back to top)') AS boiler
      FROM l WHERE len(w) > 0),
s AS (SELECT rid, count(*) - count(DISTINCT line) AS dups,
        sum(CASE WHEN (seps >= 2 AND 4 * seps >= n) OR 2 * noisy > n OR (n < 5 AND NOT ends) OR (n <= 20 AND boiler) THEN n ELSE 0 END) AS lost
      FROM k GROUP BY rid),
m AS (SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        coalesce(s.dups, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(s.lost, 0)::BIGINT AS lost_words
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN s USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_words <= n_words AS kept
FROM m
"""
