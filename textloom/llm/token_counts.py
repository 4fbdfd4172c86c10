"""Token counts by overlap resynchronisation.

Byte-level BPE first parts a text into pre-tokens, scanning from the left, and
then merges inside each. A text over ``chunk`` characters is encoded in chunks
that overlap, with the offsets of all tokens. Two chunks are spliced at a stable
boundary that their overlap has in common: a white-space character right behind
another character. No pre-token (and no special string) holds the two in this
order, so every scan that passes the place starts a pre-token there, whatever came
before, and the left chunk's tokens up to it depend on nothing beyond it. The
code also checks that both chunks have a token's start at the place and agree on
the tokens behind it. If an overlap holds no such place, it is doubled, up to the
whole text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, by_size, table, texts

CHUNK, OVERLAP = 1 << 13, 1 << 9
LIMIT = 512
SPACE = " \t\n\r\x0b\x0c"
LONG_WORD = 1 << 14  #: characters of a word that the library alone encodes
_LONG_SPACE = re.compile(r"\s{4096}")  #: so is this


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache
def _fast(path: str):
    """The same vocabulary in a faster encoder, if a rank file lies beside it: its
    tokens' byte lengths are their offsets. None if it isn't there."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in _library(path).get_added_tokens_decoder().items()}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens=special)


@lru_cache
def _sizes(path: str) -> np.ndarray:
    """Bytes of each token."""
    fast = _fast(path)
    return np.array([len(fast.decode_single_token_bytes(i)) for i in range(fast.n_vocab)])


def _ids(path: str, text: str) -> np.ndarray | None:
    """Ids by the faster encoder; None if there is none, or if it gives up, as it does on long
    white space."""
    fast = _fast(path)
    if fast and (len(text) < 4096 or not _LONG_SPACE.search(text) and max(map(len, text.split()), default=0) < LONG_WORD):
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except (ValueError, RuntimeError):
            pass
    return None


def encoded(path: str, text: str) -> tuple[list[int], dict[int, int]]:
    """Ids, and by place the first token that starts there; a token that starts inside a
    character, or behind white space that is its own, has a place that is no boundary."""
    ids = _ids(path, text)
    if ids is None:
        e = _library(path).encode(text, add_special_tokens=False)
        return e.ids, {start: k for k, (start, _) in reversed(list(enumerate(e.offsets)))}
    size = _sizes(path)[ids]
    begin = np.cumsum(size) - size
    if text.isascii():
        return ids.tolist(), dict(zip(begin.tolist(), range(len(ids)), strict=True))
    head = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    whole = np.flatnonzero(head[begin])
    return ids.tolist(), dict(zip((np.cumsum(head) - 1)[begin[whole]].tolist(), whole.tolist(), strict=True))


def stable(text: str, first: int, last: int) -> list[int]:
    """Places from ``first`` on and before ``last`` where any scan starts a pre-token."""
    return [p for p in range(max(first, 1), last) if text[p] in SPACE and not text[p - 1].isspace()]


def spliced(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length. No more than ``chunk`` characters and two
    overlaps are encoded at once, unless overlaps have to be widened."""
    total, begin, now = 0, 0, chunk  # tokens before ``begin``, a stable boundary
    while True:
        end = min(begin + now, len(text))
        ids, places = encoded(path, text[begin:end])
        if end == len(text):
            return total + len(ids)
        width = overlap
        while True:
            start = end - width
            if start <= begin:  # widened to the whole chunk: take a longer one
                now *= 2
                break
            candidates = stable(text, start + 1, end)
            found = None
            if candidates:
                right, at = encoded(path, text[start : end + overlap])
                for p in reversed(candidates):
                    k, j = places.get(p - begin), at.get(p - start)
                    # tokens behind the place agree, up to the last that the left chunk cuts off
                    if k is not None and j is not None and ids[k] == right[j] and k + 1 < len(ids):
                        found = (p, k)
                        break
            if found:
                total, begin, now = total + found[1], found[0], chunk
                break
            width *= 2


def count(path: str, rows: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    out = [0] * len(rows)
    left = []
    for k, t in enumerate(rows):
        if len(t) > chunk:
            out[k] = spliced(path, t, chunk, overlap)
        elif t and (ids := _ids(path, t)) is not None:
            out[k] = len(ids)
        elif t:
            left.append(k)
    for _, part in by_size(left, lambda k: len(rows[k]), 1 << 20):
        for k, e in zip(part, _library(path).encode_batch_fast([rows[k] for k in part], add_special_tokens=False), strict=True):
            out[k] = len(e.ids)
    return out


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizers library over the whole text, without added
    tokens; special strings in a text are special tokens, the library's default.
    What the faster encoder cannot take (very long white space) goes to the library.
    Null and empty texts count 0. Repeated rows stay rows; a null doc_id stays null.
    Extra columns are not read.
    """
    path = vocabulary or default_vocabulary()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(count(path, rows, chunk, overlap), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts; see ``token_counts`` for nulls, empty texts and repeated rows."""
    return token_counts(table(spark, sf_dir, "documents"))
