"""SentencePiece encoding and decoding by suffix-array matching.

A text becomes characters with white space as U+2581 and one more in front, and
falls apart into segments at places that no piece spans: before a U+2581 behind
another character, and around a line feed. Different segments of a batch that the
task does not remember are laid end to end and indexed by a suffix array (by
prefix doubling, as deep as the longest piece); every piece of the vocabulary is
binary-searched in it, which gives the range of all its occurrences; these edges
(place, length, piece), sorted by place, are relaxed.

The model is of the BPE kind, whose encoding is not the lattice's best path but
the result of merges in order. So relaxing means: of all edges whose two halves are
current symbols, the one of the best score, leftmost among equals, replaces its
halves, until none is left. Places that no edge crosses part the work into runs;
runs of like length take a step at once, long ones go through a heap, so time grows
with the length of a text times its logarithm at most, with or without white space
in it. What is no piece falls back to byte pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, in_arrow, table, texts

SPACE = "▁"
CACHE = 250_000  #: segments that a task remembers
BATCH_CHARS = 200_000  #: characters that one suffix array indexes, about
LONG_SEGMENT = 4_096  #: longer ones are parted where no edge crosses before they are encoded, and not remembered
WIDTHS = (4, 8, 16, 32, 64)  #: of the tables in which runs merge; longer runs go through a heap
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")
_NONE = np.iinfo(np.int32).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a BPE model with byte fallback and no normalisation but white space."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is needed")
        pieces = model.pieces
        self.text = [p.piece for p in pieces]
        normal = [i for i, p in enumerate(pieces) if p.type in (1, 4)]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) or "\n" in self.text[i] and len(self.text[i]) > 1 for i in normal):
            raise ValueError("a piece spans segments")
        self.byte = np.array([next(i for i, p in enumerate(pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.raw = [bytes([int(t[3:5], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else t.replace(SPACE, " ").encode() for t, p in zip(self.text, pieces, strict=True)]
        self.single = {self.text[i]: i for i in normal if len(self.text[i]) == 1}
        self.longer = np.array([i for i in normal if len(self.text[i]) > 1], np.int32)
        self.longest = max(len(self.text[i]) for i in self.longer)
        # the order of merges: by score, equal scores alike
        score = np.array([p.score for p in pieces])
        _, rank = np.unique(-score, return_inverse=True)
        self.rank = rank.astype(np.int64)
        alphabet = sorted({c for i in self.longer for c in self.text[i]})
        if self.longest > 16 or len(alphabet) > 0xFFFE:
            raise ValueError("pieces of 16 characters at most are needed")
        self.code = np.zeros(0x110000, np.uint16)  # 0: in no longer piece
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.lengths = np.array([len(self.text[i]) for i in self.longer])
        self.ids = {self.text[i]: int(i) for i in self.longer.tolist()}
        self.place = {self.text[i]: int(self.rank[i]) for i in self.longer.tolist()}
        self.order = np.append(self.rank, _NONE).astype(np.int64)  # at -1: no piece
        self.one = np.full(0x110000, -1, np.int32)
        for c, i in self.single.items():
            self.one[ord(c)] = i
        # pieces as blocks of four characters: the least and the greatest block that each may be
        codes = np.zeros((len(self.longer), 16), np.uint64)
        for k, i in enumerate(self.longer.tolist()):
            codes[k, : len(self.text[i])] = self.code[[ord(c) for c in self.text[i]]]
        inside = np.arange(16) < self.lengths[:, None]
        blocks = np.stack((self._packed(codes), self._packed(np.where(inside, codes, np.uint64(0xFFFF)))), -1)
        self.blocks, self.block_of = np.unique(blocks.reshape(-1, 2), axis=0, return_inverse=True)
        self.block_of = self.block_of.reshape(-1, 4)
        self.raw_size = np.array([len(x) for x in self.raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    @staticmethod
    def _packed(codes: np.ndarray) -> np.ndarray:
        c = codes.reshape(*codes.shape[:-1], -1, 4)
        return c[..., 0] << np.uint64(48) | c[..., 1] << np.uint64(32) | c[..., 2] << np.uint64(16) | c[..., 3]

    def edges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of every occurrence of every piece of two characters or more, by place.

        The suffix array is made by prefix doubling: suffixes are ranked by 4 characters,
        then by pairs of such ranks, and so on. A piece narrows from an interval of
        ranks of each of its blocks to one of ranks of the whole in the same steps."""
        n = len(chars)
        c = np.concatenate((self.code[chars], np.zeros(16, np.uint16))).astype(np.uint64)
        key = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
        low, high, depth = None, None, 4
        while True:
            order = np.argsort(key)
            ranked = key[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            known = ranked[first]
            if low is None:
                low = np.searchsorted(known, self.blocks[:, 0], "left")[self.block_of]
                high = np.searchsorted(known, self.blocks[:, 1], "right")[self.block_of]
            else:
                # the first half is told whole, or nothing of the second is
                starts = np.arange(0, 16, depth)
                whole = self.lengths[:, None] - starts > depth // 2
                l, h, l2, h2 = (x.astype(np.uint64) for x in (low[:, 0::2], high[:, 0::2], low[:, 1::2], high[:, 1::2]))
                at, to = l << np.uint64(32) | np.where(whole, l2, np.uint64(0)), np.where(whole, l << np.uint64(32) | h2, h << np.uint64(32))
                none = whole & (h <= l)
                low, high = np.searchsorted(known, at, "left"), np.searchsorted(known, to, "left")
                high = np.where(none, low, high)
            if depth >= 16:
                break
            rank = np.empty(len(key), np.int64)
            rank[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            rank = rank.astype(np.uint64)
            behind = np.concatenate((rank[depth:], np.full(depth, rank[-1])))  # the last suffix is of zeros, the least
            key = rank << np.uint64(32) | behind
            depth *= 2
        ends = np.append(first, len(key))
        low, high = ends[low[:, 0]], ends[high[:, 0]]
        found = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(found)), found)
        within = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        place = order[low[which] + within]
        by = np.argsort(place, kind="stable")
        return place[by], self.lengths[which][by], self.longer[which][by]

    def crossed(self, place: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
        """Of n + 1 places between characters, those inside an edge."""
        inside = np.bincount(place + 1, minlength=n + 2) - np.bincount(place + length, minlength=n + 2)
        return np.cumsum(inside)[: n + 1] > 0

    def merged(self, text: str) -> list[int]:
        """Sizes of a run's symbols (0 behind the first character of each) by a heap of merges."""
        n, longest, place = len(text), self.longest, self.place
        size, before = [1] * n, list(range(-1, n - 1))
        # a merge as one number: the piece's place in the order, the left symbol's, both sizes
        heap = [x << 50 | i << 10 | 33 for i in range(n - 1) if (x := place.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i, a, b = x >> 10 & 0xFFFFFFFFFF, x >> 5 & 31, x & 31
            j = i + a
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j] = a + b, 0
            j += b
            a += b
            if j < n:
                before[j] = i
                if a + size[j] <= longest and (x := place.get(text[i : j + size[j]])) is not None:
                    heapq.heappush(heap, x << 50 | i << 10 | a << 5 | size[j])
            j = before[i]
            if j >= 0 and size[j] + a <= longest and (x := place.get(text[j : i + a])) is not None:
                heapq.heappush(heap, x << 50 | j << 10 | size[j] << 5 | a)
        return size

    def segments(self, parts: list[str]) -> list[bytes]:
        """Ids of each segment as little-endian 32-bit integers."""
        text = "\0".join(parts) + "\0"
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(chars)
        place, length, piece = self.edges(chars)
        grid = np.full((n, self.longest + 1), -1, np.int32)
        grid[place, length] = piece
        ends = np.cumsum([len(p) + 1 for p in parts])  # behind each separator
        size = np.ones(n + 1, np.int64)
        size[ends - 1] = 0
        size[n] = 0
        starts = np.flatnonzero(~self.crossed(place, length, n)[:n])
        runs = np.diff(np.append(starts, n))
        starts, runs = starts[runs > 1], runs[runs > 1]
        least = 1
        for width in WIDTHS:
            now = (runs > least) & (runs <= width)
            least = width
            if now.any():
                self._relax(grid, starts[now], runs[now], width, size)
        for s, k in zip(starts[runs > least].tolist(), runs[runs > least].tolist(), strict=True):
            size[s : s + k] = self.merged(text[s : s + k])
        at = np.flatnonzero(size)
        size = size[at]
        ids = np.where(size > 1, grid[at, size], self.one[chars[at]])
        count = np.ones(len(at), np.int64)
        other = np.flatnonzero(ids < 0)
        if len(other):
            cp = chars[at[other]].astype(np.int64)
            count[other] = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
            out = np.repeat(ids, count)
            k = np.arange(count[other].sum()) - np.repeat(np.cumsum(count[other]) - count[other], count[other])
            cp, long = np.repeat(cp, count[other]), np.repeat(count[other], count[other])
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[long] | cp >> 6 * (long - 1)
            out[np.repeat(ids < 0, count)] = self.byte[np.where(k == 0, lead, 0x80 | cp >> np.maximum(6 * (long - 1 - k), 0) & 0x3F)]
            ids = out
        data = ids.astype("<i4").tobytes()
        upto = (4 * np.concatenate(([0], np.cumsum(count)))[np.searchsorted(at, ends)]).tolist()
        return [data[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]

    def _relax(self, grid: np.ndarray, starts: np.ndarray, runs: np.ndarray, width: int, size_of: np.ndarray) -> None:
        """Merge in runs of up to ``width`` characters, one merge a run and step, and put the
        sizes of their symbols into ``size_of``."""
        column = np.arange(width + 1)
        size = (column < runs[:, None]).astype(np.int64)
        before = np.broadcast_to(column - 1, size.shape).copy()
        where = np.minimum(starts[:, None] + column, len(grid) - 1)
        rank = self.order[np.where(column + 1 < runs[:, None], grid[where, 2], -1)]
        longest = self.longest

        def pair(row, i, both):
            ok = both <= longest
            return self.order[np.where(ok, grid[starts[row] + i, np.where(ok, both, 0)], -1)]

        live = np.arange(len(starts))
        while len(live):
            held = rank[live]
            j = held.argmin(1)
            some = held[np.arange(len(live)), j] < _NONE
            live, j = live[some], j[some]
            if not len(live):
                break
            nxt = j + size[live, j]
            new = size[live, j] + size[live, nxt]
            size[live, j], size[live, nxt] = new, 0
            rank[live, nxt] = _NONE
            behind = j + new
            more = size[live, behind]  # 0 behind the run's end
            before[live, behind] = j
            rank[live, j] = np.where(more > 0, pair(live, j, np.where(more > 0, new + more, 99)), _NONE)
            p = before[live, j]
            has = p >= 0
            row, p = live[has], p[has]
            rank[row, p] = pair(row, p, size[row, p] + new[has])
        inside = column < runs[:, None]
        size_of[(starts[:, None] + column)[inside]] = size[inside]

    def apart(self, text: str) -> list[str]:
        """A long segment in parts of up to ``LONG_SEGMENT`` characters, cut where no edge
        crosses; longer where there is no such place."""
        cuts = []
        for first in range(0, len(text), BATCH_CHARS):
            begin, end = max(first - self.longest, 0), min(first + BATCH_CHARS + self.longest, len(text))
            chars = np.frombuffer(text[begin:end].encode("utf-32-le"), np.uint32)
            place, length, _ = self.edges(chars)
            free = np.flatnonzero(~self.crossed(place, length, len(chars))) + begin
            cuts.append(free[(free >= first) & (free < first + BATCH_CHARS)])
        cuts = np.append(np.concatenate(cuts), len(text))
        out, at = [], 0
        while at < len(text):
            k = int(np.searchsorted(cuts, at + LONG_SEGMENT, "right"))
            to = int(cuts[k - 1]) if k and cuts[k - 1] > at else int(cuts[k])
            out.append(text[at:to])
            at = to
        return out

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of runs of ids, as ``decode`` has them."""
        size = self.raw_size[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        data = self.raw_bytes[np.repeat(self.raw_at[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        at = upto[offsets].tolist()
        return [data[a + (data[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces, bytes joined, the space in front left out."""
        data = b"".join(map(self.raw.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.cache: dict[str, bytes] = {}

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [_SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in rows]
        every = set().union(*cut)
        long = {s: self._long(s) for s in every if len(s) > LONG_SEGMENT}
        every.difference_update(long)
        new = every.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = every
        self._learn(new)
        if not long:
            return [b"".join(map(self.cache.__getitem__, c)) for c in cut]
        return [b"".join([long[s] if s in long else self.cache[s] for s in c]) for c in cut]

    def _learn(self, new: set[str]) -> None:
        run, size = [], 0
        for s in new:
            run.append(s)
            size += len(s) + 1
            if size >= BATCH_CHARS:
                self.cache.update(zip(run, self.pieces.segments(run), strict=True))
                run, size = [], 0
        if run:
            self.cache.update(zip(run, self.pieces.segments(run), strict=True))

    def _long(self, segment: str) -> bytes:
        parts = self.pieces.apart(segment)
        short = list({p for p in parts if len(p) <= LONG_SEGMENT})
        known: dict[str, bytes] = {}
        for k in range(0, len(short), step := BATCH_CHARS // LONG_SEGMENT):
            known |= zip(short[k : k + step], self.pieces.segments(short[k : k + step]), strict=True)
        return b"".join([known[p] if p in known else self._run(p) for p in parts])

    def _run(self, text: str) -> bytes:
        """A run that nothing parts."""
        out, at = [], 0
        for n in filter(None, self.pieces.merged(text)):
            c = text[at : at + n]
            at += n
            i = self.pieces.ids[c] if n > 1 else self.pieces.single.get(c, -1)
            out += [i] if i >= 0 else self.pieces.byte[list(c.encode())].tolist()
        return np.array(out, "<i4").tobytes()


@lru_cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>, n_pieces, ids_crc32 (of the
    ids as little-endian 32-bit integers), and with ``decode`` decoded, the text of the ids.

    Ids are those of the sentencepiece library without begin and end. A null or
    empty text has no ids and decodes to the empty text. Repeated rows stay rows; a
    null doc_id stays null. Extra columns are not read.
    """
    path = model or default_model()
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 250):
                part = batch.slice(first, 250)
                ids = e.encode(texts(part))
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4")
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.diff(offsets).astype(np.int64)), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if decode:
                    columns.append(pa.array(e.pieces.decoded(flat, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_pieces", "ids_crc32", "decoded"][: len(columns)])
        e.cache.clear()  # the worker serves other stages next

    return in_arrow(docs.select("doc_id", F.col(text).alias("text")), run, schema)


def encode_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every document, with their number and checksum, and
    the text that they decode to."""
    return encode(docs)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by number and checksum, and the decoded text by length and md5."""
    out = encode(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_pieces", "ids_crc32", F.length("decoded").cast("long").alias("decoded_chars"), F.md5("decoded").alias("decoded_md5"))
