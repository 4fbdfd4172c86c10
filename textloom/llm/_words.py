"""Words of many texts at once, as numpy arrays: no Python loop over words.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix
sums of the whole buffer, then mixed. Any slice of a word (a prefix, say) has
its hash from the same sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48

BLOCK = 1 << 20  #: bytes of a long text that are looked at together
_ANY_SPACE = re.compile(rb"[\x20\x09-\x0d]")

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser whose low bits depend on every bit of ``h``."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of a batch in order: the text each belongs to, its bytes and hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    sums: np.ndarray
    buffer: np.ndarray
    n_docs: int

    def slice_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _power(len(self.sums))[1][start]


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    buffer = _LOWER[raw] if lower else raw
    space = _SPACE[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    power, _ = _power(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)], out=sums[1:])
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1] if texts else np.zeros(0, int)
    doc = np.searchsorted(firsts, start, "right") - 1
    out = Words(doc, start, end, start, sums, buffer, len(texts))
    out.hash = out.slice_hash(start, end)
    return out


def blocks(text: bytes, most: int = BLOCK) -> Iterator[bytes]:
    """A text in pieces of up to ``most`` bytes, cut at white space, so memory does not grow
    with it. Of a word longer than that its first bytes and a digest stand for it."""
    at = 0
    while len(text) - at > most:
        space = max(text.rfind(c, at, at + most) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if space > at:
            yield text[at:space]
            at = space
            continue
        found = _ANY_SPACE.search(text, at + 1)
        end = found.start() if found else len(text)
        word = text[at:end].lstrip(b" \n\t\r\x0b\x0c")
        yield word if len(word) <= most else word[:16] + hashlib.blake2b(word, digest_size=16).hexdigest().encode()
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word, A-Z lower-cased, in order; long texts go by blocks."""
    if sum(map(len, texts)) <= 2 * BLOCK:
        w = words_of(texts, lower=True)
        return w.doc, w.hash
    docs, hashes = [], []
    for k, t in enumerate(texts):
        for part in blocks(t):
            h = words_of([part], lower=True).hash
            docs.append(np.full(len(h), k, np.int64))
            hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


def shapes_of(w: Words) -> np.ndarray:
    """A hash of each word's shape: letters by case and digits as classes, runs
    of one class or character collapsed, other punctuation kept."""
    kind = _CLASS[w.buffer]
    kept = np.ones(len(kind), bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[w.start] = True
    place = np.cumsum(kept) - 1
    power, inverse = _power(len(kind) + 1)
    sums = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum(np.where(kept, (kind.astype(np.uint64) + np.uint64(1)) * power[place], np.uint64(0)), out=sums[1:])
    return (sums[w.end] - sums[w.start]) * inverse[place[w.start]]
