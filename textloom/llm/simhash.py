"""SimHash fingerprints linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last
padded with zeros). The binary Golay code of length 23 is perfect: each 23-bit
word lies within 3 bits of exactly one codeword. A segment's keys are the
12-bit indices of all codewords within 4 bits of it: one key if it lies within
2 bits of its codeword, else six. Two segments that differ in one bit at most
always share a key, since the codeword within 3 bits of one is within 4 bits of
the other.

Three errors at most over three segments leave, by the pigeonhole principle,
either one segment without an error beside one with one at most (keys "A":
the exact segment with a Golay index of another), or one error in each (keys
"B": Golay indices of the two long segments, with the exact half of the short
one that the error spared). A key fits in 64 bits; about 88 keys a fingerprint.
Fingerprints with a common key meet, are verified on all 64 bits and leave the
edges of a spanning forest, so a large group never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, by_ids, by_size, discard, in_arrow, stash, table, texts
from ._words import mix, word_hashes
from .components import EDGE, components

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
SEED = 42


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint of one text: bit i is set if over half of its shingles' hashes have it; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in parts), np.uint64)
    n = len(h)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit index, and by syndrome the error patterns of weight
    4 at most (the one of weight 3 at most first; -1 where there are fewer than six)."""

    def parity(info: int) -> int:
        rest = info << 11
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= GENERATOR << (k - 11)
        return rest

    parities = np.array([parity(k) for k in range(1 << 12)], np.int64)
    errors = np.full((1 << 11, 6), -1, np.int64)
    filled = [0] * (1 << 11)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(parities[e >> 11]) ^ (e & 2047)
            if weight < 4 or (errors[s, 0] >= 0 and bin(int(errors[s, 0])).count("1") == 3):
                errors[s, filled[s]] = e
                filled[s] += 1
    return parities, errors


def golay_keys(v: np.ndarray) -> np.ndarray:
    """(n, 6): the indices of the codewords within 4 bits of each 23-bit word; -1 fills."""
    parities, errors = golay()
    e = errors[parities[v >> 11] ^ (v & 2047)]
    return np.where(e < 0, -1, (v[:, None] ^ e) >> 11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for every key of each fingerprint (int64)."""
    u = fps.astype(np.int64).view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18))]
    idx = [golay_keys(s) for s in seg]
    out = []
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                at, k = np.nonzero(idx[j] >= 0)
                out.append((at, (np.int64(tag) << 60) | (seg[i][at] << 12) | idx[j][at, k]))
                tag += 1
    two = (idx[0][:, :, None] << 12 | idx[1][:, None, :]).reshape(len(u), 36)
    two[((idx[0] < 0)[:, :, None] | (idx[1] < 0)[:, None, :]).reshape(len(u), 36)] = -1
    at, k = np.nonzero(two >= 0)
    for half in (0, 1):
        out.append((at, (np.int64(6 + half) << 60) | (two[at, k] << 9) | (seg[2][at] >> (9 * half) & 511)))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 4096):
            part = fps[k : k + 4096]
            at, key = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], names=["key", "fp"])


def forest(fps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints: each
    one reached looks once at those not yet reached."""
    left = fps.view(np.uint64)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                for y in left[near]:
                    yield int(x.view(np.int64)), int(y.view(np.int64))
                front.extend(left[near])
                left = left[~near]


def _verified(most: int):
    """Edges among the fingerprints of each bucket, from rows in order of their key: a task
    holds one batch of rows and one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _buckets(batches):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            two = first[size == 2]
            near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= most
            a, b = [fp[two[near]]], [fp[two[near] + 1]]
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if edges := list(forest(fp[s : s + n], most)):
                    e = np.array(edges, np.int64)
                    a.append(e[:, 0])
                    b.append(e[:, 1])
            pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; a null or wordless text has fingerprint 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_signed(fingerprint(t, shingle)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return in_arrow(docs.select("doc_id", F.col(text).alias("text")), run, "doc_id long, fp long")


def _linked(prints: DataFrame, most: int) -> DataFrame:
    """Edges of a spanning forest of each bucket of distinct fingerprints (fp). A fingerprint
    becomes some 88 rows, so they are dealt out anew before, by their number."""
    spark = prints.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // KEYS_TASK))
    keyed = in_arrow(prints.repartition(tasks), _key_rows, "key long, fp long")
    return in_arrow(keyed.repartition("key").sortWithinPartitions("key", "fp"), _verified(most), EDGE)


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp long, component_id.

    Fingerprints link at ``most`` (3 or fewer) differing bits; component_id is the
    smallest doc_id that links reach, itself included. Equal fingerprints are one
    node, whatever their number, so copies cost nothing beyond their own row.
    Nulls and empty texts have fingerprint 0 and link like any other; a row with a
    null doc_id takes part but never gives its id (component_id is null only if no
    row of its component has one). Repeated rows stay rows. Extra columns are not read.
    """
    if not 0 <= most <= 3:
        raise ValueError("most must be 0 to 3: the keys find links of up to 3 bits")
    prints = stash(fingerprints(docs, text, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(_linked(nodes.select("fp"), most))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# Near copies by similarity. At a Jaccard similarity of 0.8 a tenth to a sixth of all
# bits differ, so fingerprints within three bits link the closest copies alone. They come
# first and contract large groups. The pairs they miss meet by prefixes of the sets, and
# none is lost: two sets of similarity t share at least t of either's hashes, so in any
# order common to all sets their first n - ceil(t * n) + 1 hashes meet, of n. Rare hashes
# come first: those that the whole corpus holds often are last, so a passage in many
# texts is a key of few. Order decides costs alone. Pairs that meet are told apart by
# counts of hashes by range, whose distance is at most that of the sets, and those
# left are verified on the sets of shingles.

SMALL = 8  #: rows of a bucket up to which all its pairs are compared at once
PIVOTS = (0, 8, None)  #: of larger ones by round; the last compares all that is not linked by then
MOST_HELD = 1 << 17  #: pairs a task holds
COMMON_BITS = 20  #: of a hash, by which common ones are known
DEVIATIONS = 6  #: above the mean, from which a count of such hashes is common
COUNTS_ROW = 1 << 16  #: counts in a row
KEYS_TASK = 20_000  #: fingerprints whose keys one task makes


def shingle_hashes(text: str, shingle: int = 5) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    return shingle_sets([text], shingle)[0]


_STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)


def shingle_sets(rows: list[str], shingle: int = 5) -> list[np.ndarray]:
    """The different hashes of each text's shingles, in order. Words are parted by ASCII
    white space and A-Z lower-cased; of fewer words than ``shingle`` the whole sequence is
    the one shingle; without words there is none."""
    doc, h = word_hashes([t.encode() for t in rows])
    n, words = len(h), np.bincount(doc, minlength=len(rows))
    if not n:
        return [np.zeros(0, np.uint64)] * len(rows)
    h = mix(h, 41)
    total = h * _STEPS[0]
    for k in range(1, min(shingle, n)):
        total[: n - k] += np.where(doc[k:] == doc[: n - k], h[k:] * _STEPS[k], np.uint64(0))
    first = np.cumsum(words) - words
    whole = np.arange(n) <= (first + words - shingle)[doc]
    whole[first[(words > 0) & (words < shingle)]] = True
    total = mix(total[whole], 43)
    upto = np.concatenate(([0], np.cumsum(np.where(words > 0, np.maximum(words - shingle + 1, 1), 0))))
    return [np.unique(total[i:j]) for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A fingerprint of each set: bit i is set if over half of its hashes have it."""
    out = np.zeros(len(sets), np.int64)
    for at, part in by_size(sets, len, 1 << 17):
        n = np.array([len(x) for x in part])
        some = np.flatnonzero(n)
        if len(some):
            bits = np.unpackbits(np.concatenate(part).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
            out[at + some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").copy().view("<i8").reshape(-1)
    return out


def spectrum(hashes: np.ndarray) -> np.ndarray:
    """How many hashes lie in each of equal ranges, as many ranges as hashes or up to twice that."""
    bits = min(max(6, int(len(hashes) - 1).bit_length()), 20)
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def folded(counts: np.ndarray, ranges: int) -> np.ndarray:
    """Spectra (any shape, ranges last) of so many ranges, no more than they have."""
    return np.minimum(counts.reshape(*counts.shape[:-1], ranges, -1).sum(-1, dtype=np.int32), 255)


def may_be_near(x: np.ndarray, y: np.ndarray, n: int, m: int, least: float) -> bool:
    """Whether sets of n and m hashes with these spectra can have a similarity of ``least``:
    their symmetric difference is at least the distance of the spectra."""
    k = min(len(x), len(y))
    return float(np.abs(folded(x, k) - folded(y, k)).sum()) <= (1 - least) / (1 + least) * (n + m) + 1e-6


def prefix(hashes: np.ndarray, least: float, common: np.ndarray) -> np.ndarray:
    """The first hashes of a set, rare ones first, of which sets of a similarity of ``least``
    or more share one at least."""
    late = common[(hashes >> np.uint64(64 - COMMON_BITS)).astype(np.int64)]
    n = len(hashes)
    return np.concatenate((hashes[~late], hashes[late]))[: n - int(np.ceil(least * n - 1e-9)) + 1]


LINK = "key long, a long, b long, size int, pos int"  #: a pair to verify has no key; a row that is left has key and node


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, from rows in order of their key."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if held and (cut or now[0][0] != held[0][0][0]):
            whole = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now])]
            held = [[c[cut:] for c in now]]
            yield whole
        elif held:
            held.append(now)
        else:
            held = [[c[cut:] for c in now]]
            if cut:
                yield [c[:cut] for c in now]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _met(pivots: int | None, least: float):
    """Pairs of nodes with a common key that are to be verified, by bucket: all pairs of a
    small one or, with ``pivots`` None, of any; of a large one those of its first node
    (0) or of so many pivots with every other row, while the rest of its rows is left for
    the next round. Rows of one root are linked already and no pair, nor are those whose
    sizes, places of a first common hash, or (in the last round, whose rows carry them)
    spectra leave too little to share. Rows come in order of key and, in the first round, node,
    so that buckets agree on the first; then in order of key and place: the pivots are the rows
    with the fewest rarer hashes, which edits of one text have in common. A task holds one batch
    of rows and one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(a: list, b: list) -> pa.RecordBatch:
            pairs = np.stack((np.concatenate(a), np.concatenate(b)), 1)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), *[pa.nulls(len(pairs), pa.int32())] * 2], names=["key", "a", "b", "size", "pos"])

        a, b, held = [], [], 0
        for key, node, size_of, pos, root, *spectra in _buckets(batches):

            def able(x, y):
                shared = np.minimum(size_of[x] - pos[x], size_of[y] - pos[y])  # at most
                return (shared >= least / (1 + least) * (size_of[x].astype(np.int64) + size_of[y]) - 1e-6) & (root[x] != root[y])

            def alike(x: int, left: np.ndarray) -> np.ndarray:
                own = np.frombuffer(spectra[0][x], np.uint8)
                return np.array([may_be_near(own, np.frombuffer(spectra[0][y], np.uint8), size_of[x], size_of[y], least) for y in left.tolist()], bool)

            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            place = np.arange(len(key))
            rest = []
            if pivots == 0:
                large = np.repeat(size > SMALL, size)
                for gap in range(1, min(SMALL, len(key))):
                    x = place[:-gap][(key[gap:] == key[:-gap]) & ~large[gap:]]
                    x = x[able(x, x + gap)]
                    a.append(node[x])
                    b.append(node[x + gap])
                    held += len(x)
            todo = size > (SMALL if pivots == 0 else 1)
            for s, n in zip(first[todo].tolist(), size[todo].tolist(), strict=True):
                if (root[s : s + n] == root[s]).all():
                    continue
                left = place[s : s + n]
                for x in left.tolist() if pivots is None else left[: max(pivots, 1)].tolist():
                    left = left[1:]
                    near = left[able(left, x)]
                    if spectra and len(near):
                        near = near[alike(x, near)]
                    a.append(node[near])
                    b.append(np.full(len(near), node[x]))
                    held += len(near)
                    if held > MOST_HELD:
                        yield told(a, b)
                        a, b, held = [], [], 0
                if pivots is not None:
                    rest.append(place[s : s + n] if not pivots else left)
            if held > 1 << 16:
                yield told(a, b)
                a, b, held = [], [], 0
            if rest:
                left = np.concatenate(rest)
                yield pa.RecordBatch.from_arrays([pa.array(key[left]), pa.array(node[left]), pa.nulls(len(left), pa.int64()), pa.array(size_of[left]), pa.array(pos[left])], names=["key", "a", "b", "size", "pos"])
        if held:
            yield told(a, b)

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _prints(shingle: int):
    """What is known of each text by one look at it: doc_id, held (a hash of its set of shingles),
    size, fp and spectrum of the set. Behind the texts of a task, with no doc_id, come counts of all
    their hashes by their first bits, in rows of ``COUNTS_ROW`` counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held", "size", "fp", "spectrum", "part", "counts"]
        counts = np.zeros(1 << COMMON_BITS, np.int64)

        for batch in batches:
            ids, at = batch.column(0), 0
            for at, part in by_size(texts(batch), len, 1 << 20):
                sets = shingle_sets(part, shingle)
                for k in range(0, len(sets), 64):
                    some = np.concatenate(sets[k : k + 64])
                    counts += np.bincount((some >> np.uint64(64 - COMMON_BITS)).astype(np.int64), minlength=1 << COMMON_BITS) if len(some) > 1 << 17 else 0
                    if len(some) <= 1 << 17:
                        np.add.at(counts, (some >> np.uint64(64 - COMMON_BITS)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array(set_fingerprints(sets)),
                     pa.array([spectrum(x).tobytes() for x in sets], pa.binary()), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())], names=names)
        for k in range(0, len(counts), COUNTS_ROW):
            some = counts[k : k + COUNTS_ROW]
            if some.any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary())], pa.array([k // COUNTS_ROW], pa.int32()), pa.array([some.astype("<i8").tobytes()], pa.binary())], names=names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows of counts: however many come, a task holds one for each part."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<i8")
    for part, counts in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["part", "counts"])


def _common(counted: DataFrame) -> np.ndarray:
    """By the first bits of a hash: whether the corpus holds such hashes far more often than
    most. All texts count; the driver gets 2**COMMON_BITS counts, whatever the corpus."""
    counts = np.zeros(1 << COMMON_BITS, np.int64)
    for part, some in in_arrow(counted.repartition("part"), _added, "part int, counts binary").collect():
        counts[part * COUNTS_ROW : (part + 1) * COUNTS_ROW] += np.frombuffer(some, "<i8")
    mean = float(np.median(counts))
    return counts > mean + DEVIATIONS * max(np.sqrt(mean), 1)


def near_copies(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) of every doc_id of ``docs``: texts whose sets of ``shingle``-word
    shingles have a Jaccard similarity of ``least`` or more are linked; component_id is the
    smallest doc_id that links reach, itself included.

    No pair is lost on the way (see above). Texts of equal sets are one node. Texts without words are one group.
    Rows of one doc_id are one document; rows without a doc_id take no part.
    """
    bounded_batches(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(np.frombuffer(told_common.value, np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, part in by_size(texts(batch), len, 1 << 20):
                found = [(d, len(h), prefix(h, least, common)) for d, h in zip(ids[at : at + len(part)], shingle_sets(part, shingle), strict=True) if len(h)]
                if found:
                    n = [len(k) for _, _, k in found]
                    columns = (np.concatenate([k for _, _, k in found]).view(np.int64), np.repeat(np.array([d for d, _, _ in found], np.int64), n), np.repeat(np.array([m for _, m, _ in found], np.int32), n), np.concatenate([np.arange(k, dtype=np.int32) for k in n]))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "node", "size", "pos"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [may_be_near(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), i, j, least) for x, y, i, j in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), n, m, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(*(texts(batch, c) for c in ("x", "y")), strict=True))
            keep = []
            for _, part in by_size(pairs, lambda p: len(p[0]) + len(p[1]), 2 << 20):
                names = list({t for p in part for t in p})
                sets = dict(zip(names, shingle_sets(names, shingle), strict=True))
                keep += [similarity(sets[x], sets[y]) >= least for x, y in part]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = stash(in_arrow(rows, _prints(shingle), "doc_id long, held binary, size int, fp long, spectrum binary, part int, counts binary"), "prints")
    told_common = docs.sparkSession.sparkContext.broadcast(np.packbits(_common(seen.where("part is not null").select("part", "counts"))).tobytes())
    held = seen.where("doc_id is not null").select("doc_id", "held")
    nodes = stash(seen.where("doc_id is not null").groupBy("held").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size")), "nodes")
    spectra = seen.where("doc_id is not null").select(F.col("doc_id").alias("node"), "held", "size", "spectrum").join(nodes.select("node", "held"), ["node", "held"], "left_semi").dropDuplicates(["node"]).drop("held")
    spectra = stash(spectra, "spectra")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs of nodes (a, b) those of similar sets."""
        x, y = (spectra.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("spectrum").alias(f"s{c}")) for c in "ab")
        sized = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "sa", "sb").where(F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-6)
        near = stash(in_arrow(sized, close, EDGE), "close")
        named = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
        told = stash(by_ids(rows, named, "doc_id", True).join(named, "doc_id", "left_semi").select("doc_id", "text").distinct(), "told")
        met = near.join(told.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(told.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
        found = stash(in_arrow(met.select("a", "b", "x", "y"), exact, EDGE), "links")
        discard(near, told)
        return found

    # the closest first, by fingerprints
    by_print = nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("rep"))
    edges = _linked(by_print.select("fp"), 3)
    ends = (by_print.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}")) for c in "ab")
    for end in ends:
        edges = edges.join(end, end.columns[0])
    same = nodes.where("size > 0").join(by_print, "fp").where("node <> rep").select("node", "rep")
    tested = stash(edges.select("ra", "rb").union(same).toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = verified(tested)
    roots = components(links)

    # texts of documents that are not another's copy are read where they are
    copies = held.select("doc_id").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").distinct()
    alone = by_ids(rows, copies, "doc_id", False).union(by_ids(rows, copies, "doc_id", True).join(copies, "doc_id", "left_anti"))
    left = in_arrow(alone, keys, "key long, node long, size int, pos int").withColumn("root", F.col("node"))
    for pivots in PIVOTS:
        dealt = left.repartition("key").sortWithinPartitions("key", "pos" if pivots else "node")
        out = stash(in_arrow(dealt, _met(pivots, least), LINK), "met")
        ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        met = out.where("key is null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
        met = stash(met.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "pairs")
        if not met.isEmpty():
            tested, links = tested.union(met), links.union(verified(met))
            roots = components(links)
        rest = out.where("key is not null").select("key", F.col("a").alias("node"), "size", "pos")
        if rest.isEmpty():
            break
        left = rest.join(roots, "node", "left").select("key", "node", "size", "pos", F.coalesce("root", "node").alias("root"))
        if pivots:  # the next is the last
            left = left.join(spectra.select("node", "spectrum"), "node").select("key", "node", "size", "pos", "root", "spectrum")
    rooted = nodes.join(roots, "node", "left").select("held", F.coalesce("root", "node").alias("component_id"))
    return held.join(rooted, "held").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five-word shingles, a similarity of
    0.8 or more) the document with the smallest doc_id stays. Rows of one doc_id are one
    document, of which one row stays; rows without a doc_id all stay."""
    found = stash(near_copies(docs), "groups")
    dropped = found.where("doc_id <> component_id").select("doc_id")
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    touched = stash(dropped.union(repeated), "touched")
    # texts of documents that are neither dropped nor repeated stay where they are
    inside = by_ids(docs.where("doc_id is not null"), touched, "doc_id", True)
    kept = inside.join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    outside = by_ids(docs.where("doc_id is not null"), touched, "doc_id", False)
    return outside.unionByName(kept.select(*docs.columns)).unionByName(docs.where("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group; see ``near_duplicates`` for nulls, empty texts and repeated rows."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
