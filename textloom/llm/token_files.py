"""Token-id files: one concatenated id array, Elias-Fano document boundaries.

A shard holds documents in ascending doc_id order:

    magic "TLIDS1\\0\\0", id width in bytes u32, reserved u32, documents u64, ids u64,
    leading documents without a doc_id u64, least doc_id i64,
    the ids, little-endian,
    Elias-Fano section of the boundaries (documents + 1 values, 0 first),
    Elias-Fano section of doc_id minus the least.

An Elias-Fano section keeps n ascending values below u in n * (2 + log2(u / n))
bits: each value's low bits packed, its high part as a one in a bit array, with
the place of every 256th one (u32) so that ``select`` reads a few bytes.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, by_size, fresh_path, table, texts

MAGIC = b"TLIDS1\0\0"
HEAD = struct.Struct("<8sIIQQQq")
EF_HEAD = struct.Struct("<QQIIQ")
EVERY = 256
SHARD_BYTES = 32 << 20  #: ids of a shard, about
END_ID = 2
MANIFEST = "manifest.json"
CACHE = 240_000  #: words whose ids a worker remembers
END_OF_PART = "\x01"  #: stands behind each part of a word while it is merged


def ef_encode(values: np.ndarray, universe: int) -> bytes:
    """Ascending non-negative values, none above ``universe``."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    low = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(universe) >> low) + n + 1, np.uint8)
    high[at] = 1
    bits = (v[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1)
    lows, highs = np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    return EF_HEAD.pack(n, universe, low, EVERY, len(highs)) + at[::EVERY].astype("<u4").tobytes() + lows + highs


class EliasFano:
    """Reads a section in place: ``select(i)`` is value i, ``all()`` is every value."""

    def __init__(self, data: memoryview, at: int = 0):
        self.n, self.universe, self.low, self.every, high = EF_HEAD.unpack_from(data, at)
        at += EF_HEAD.size
        samples = -(-self.n // self.every)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        size = (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(data, np.uint8, size, at)
        self.highs = np.frombuffer(data, np.uint8, high, at + size)
        self.end = at + size + high

    def _low(self, i: int) -> int:
        first = i * self.low
        part = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little")
        return part >> first % 8 & (1 << self.low) - 1

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // self.every]), i % self.every
        byte = place // 8
        part = int(self.highs[byte]) >> place % 8 << place % 8
        while (ones := part.bit_count()) <= left:
            left -= ones
            byte += 1
            part = int(self.highs[byte])
        for _ in range(left):
            part &= part - 1
        place = byte * 8 + (part & -part).bit_length() - 1
        return (place - i) << self.low | self._low(i)

    def selects(self, i: np.ndarray) -> np.ndarray:
        """Values ``i``, many at once: running counts of ones tell the byte that holds each."""
        ones = np.bitwise_count(self.highs).astype(np.int64)
        upto = np.cumsum(ones)
        byte = np.searchsorted(upto, i, "right")
        place = byte * 8 + _PLACES[self.highs[byte], i - (upto[byte] - ones[byte])]
        high = place - i
        if not self.low:
            return high
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        return (high << self.low) + bits[i].astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def all(self) -> np.ndarray:
        return self.selects(np.arange(self.n))


#: by byte and k: the place of its k-th one
_PLACES = np.array([([b for b in range(8) if x >> b & 1] + [0] * 8)[:8] for x in range(256)])


def shard_bytes(doc_ids: list[int | None], docs: list[bytes], width: int) -> bytes:
    """A shard of documents' little-endian ids, each ``width`` bytes wide."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.concatenate(([0], np.cumsum([len(d) // width for d in docs]))).astype(np.int64)
    head = HEAD.pack(MAGIC, width, 0, len(docs), int(ends[-1]), len(doc_ids) - len(known), least)
    span = known - least
    return head + b"".join(docs) + ef_encode(ends, int(ends[-1])) + ef_encode(span, int(span[-1]) if len(span) else 0)


class Shard:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        magic, width, _, self.n, self.n_ids, self.nulls, self.least = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, HEAD.size)
        self.ends = EliasFano(memoryview(data), HEAD.size + width * self.n_ids)
        self.names = EliasFano(memoryview(data), self.ends.end)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.names.select(i - self.nulls)

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i) : self.ends.select(i + 1)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as the library gives them, word by word.

    The vocabulary's normaliser and pre-tokenizer drop white space and never join
    what it parts, so a text's ids are its words' ids in order; each different word
    of a batch is encoded once while it is remembered. Words of Latin letters, digits
    and ASCII signs are merged all at once by a compiled BPE over the same merges, with
    the end of a part as a byte of its own that merges first; any other word goes to
    the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        end = END_OF_PART.encode()

        def raw(token: str) -> bytes:
            return bytes(byte[c] for c in token.removesuffix("</w>")) + end * token.endswith("</w>")

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256):
            ranks.setdefault(bytes([b]) + end, len(ranks))
        for a, b in model["merges"]:
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        known = {raw(t): i for t, i in model["vocab"].items() if all(c in byte for c in t.removesuffix("</w>"))}
        self.of = np.zeros(len(ranks), self.kind)
        for r, k in ranks.items():
            self.of[k] = known.get(r, 0)
        self.core = tiktoken.Encoding("words", pat_str=rf"[^{END_OF_PART}\n]+{END_OF_PART}|\n", mergeable_ranks=ranks, special_tokens={})
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.simple = regex.compile("(?!.*<\\|)[\x21-\x7eÀ-įı-ňŊ-ɏ]+")
        self.cache: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Remember the ids of words."""
        simple, other = [], []
        for w in words:
            (simple if w.isalpha() or self.simple.fullmatch(w.decode()) else other).append(w)
        for k in range(0, len(simple), 50_000):
            part = simple[k : k + 50_000]
            text = self.parts.sub(rf"\g<0>{END_OF_PART}", b"\n".join(part).decode().lower())
            got = self.core.encode_to_numpy(text + "\n", disallowed_special=())
            ends = np.flatnonzero(got == 10)  # a line feed behind each word
            data, at = self.of[got].tobytes(), (self.width * np.concatenate(([0], ends + 1))).tolist()
            self.cache.update(zip(part, [data[a : b - self.width] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
        for _, part in by_size(other, len, 1 << 20):
            rows = self.library.encode_batch([w.decode() for w in part], add_special_tokens=False)
            self.cache.update(zip(part, [np.array(r.ids, self.kind).tobytes() for r in rows], strict=True))

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text, as wide as the file has them."""
        words = [t.encode().split() for t in rows]
        every = set().union(*words)
        new = every.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = every
        self.learn(new)
        return [b"".join(map(self.cache.__getitem__, w)) for w in words]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, out: str, vocabulary: str | None = None, end_id: int = END_ID, shard_size: int = SHARD_BYTES) -> list[tuple[str, int, int]]:
    """Write the ids of all documents under ``out`` (a folder that driver and
    executors share) and return (file, documents, ids) of each shard in order.

    Documents are range-partitioned by doc_id and a hash of the text, so rows without
    a doc_id, or of one, are dealt to many tasks; null ids come first; rows that share
    a doc_id go by that hash, then by their text. A file is written under a name of its
    own and then renamed to one that only depends on the partition, so a task that runs
    again replaces the same file. The driver gets a row per shard of about ``shard_size``
    bytes and writes them, last of all, as ``manifest.json``, from which ``shards_of``
    opens the folder. An empty table has a manifest without shards.
    """
    path = vocabulary or default_vocabulary()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)
        e = encoder(path)
        part, k, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], e.kind).tobytes()

        def close() -> pa.RecordBatch:
            nonlocal k, names, held, size
            name = f"ids-{part:06d}-{k:05d}.bin"
            own = f"{root}/.{name}.{uuid.uuid4().hex}"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(own) as f:
                f.write(shard_bytes(names, held, e.width))
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([name]), pa.array([len(names)]), pa.array([size // e.width])], names=["part", "k", "name", "docs", "ids"])
            k, names, held, size = k + 1, [], [], 0
            return row

        for batch in batches:
            for first in range(0, batch.num_rows, 250):
                rows = batch.slice(first, 250)
                for name, ids in zip(rows.column(0).to_pylist(), e.encode(texts(rows)), strict=True):
                    names.append(name)
                    held.append(ids + end)
                    size += len(held[-1])
                    if size >= shard_size:
                        yield close()
        if names:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows = ordered.mapInArrow(run, "part long, k long, name string, docs long, ids long").collect()
    shards = [(r.name, r.docs, r.ids) for r in sorted(rows, key=lambda r: (r.part, r.k))]
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(own := f"{root}/.{MANIFEST}.{uuid.uuid4().hex}") as f:
        f.write(json.dumps([dict(zip(("name", "documents", "ids"), x, strict=True)) for x in shards]).encode())
    store.move(own, f"{root}/{MANIFEST}")
    return [(f"{out}/{name}", n, ids) for name, n, ids in shards]


def shards_of(out: str) -> list[tuple[str, int, int]]:
    """(file, documents, ids) of each shard of a folder that ``write`` has made, in order."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return [(f"{out}/{x['name']}", x["documents"], x["ids"]) for x in json.loads(f.read())]


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone:
    a task for each shard, whose first id's place is the sum of the shards before."""
    rows, base = [], 0
    for name, _, ids in shards:
        rows.append((name, base))
        base += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_stream(at) as f:
                    shard = Shard(f.read())
                ends = shard.ends.selects(np.arange(shard.n + 1))
                names = [None] * shard.nulls + (shard.names.all() + shard.least).tolist()
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(rows, "name string, base long").repartition(len(rows)).mapInArrow(run, schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have the end id alone. Repeated rows stay rows."""
    out = fresh_path(spark, "ids")
    write(table(spark, sf_dir, "documents"), out)
    return read(spark, shards_of(out))
