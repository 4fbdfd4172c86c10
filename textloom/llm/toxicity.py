"""Toxicity by weak supervision.

1. Terms (words, and word beginnings of four to eight bytes) that mark toxic texts
   are mined from a bounded sample of labelled rows into a lexicon.
2. Voters read a text: each strong term is one, the rest of the lexicon is dealt
   to a few more, and patterns (several different terms, many for the length, none
   at all) are others.
3. A generative label model takes the votes on every whole text, labelled or not,
   as counts of vote patterns, and estimates by expectation maximisation, a pass over
   the patterns a round, how often each voter fires on either class, and from the
   residual correlations how much of its vote only repeats others'. Rows of the labelled
   sample count with their label where rates are estimated; no posterior is a label.
4. A linear classifier over hashed terms learns the model's posterior labels of a
   bounded sample of rows, and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, bounded_sample, by_size, crc_text, discard, stash, table, texts
from ._linear import Sparse, ftrl, joined, sigmoid
from ._words import BLOCK, blocks, mix, words_of
from .quality import CHUNK, LIMIT, labelled

BITS = 22  #: buckets of the classifier
FINE = 29  #: of the lexicon, so fine that terms hardly ever share one
#: A term found so often, and in one of so many words at least, is one more term.
LEVELS = ((1, 0), (2, 300), (3, 100))
LABELLED, UNLABELLED = 8_000, 8_000  #: most rows of either kind that fit the classifier
ROUNDS, SETTLED = 40, 1e-4  #: most rounds of the label model; the change of rates that ends them
FOLDS, HELD_OUT = 3, 1
LEXICON, OWN, DEALT = 1_024, 96, 16  #: terms; voters of one term; voters that share the rest
VOTERS = OWN + DEALT + 5
SIEVE = 20  #: bits of a term by which others than the lexicon's are passed over
BEGINNINGS = (4, 5, 6, 7, 8)
#: every byte but ASCII letters, digits and those of other characters parts words
_PART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(batch: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, term hash) pairs of a batch, repeats included, and the words of each text, by
    blocks of long texts."""
    whole = [[x.translate(_PART) for x in batch]]
    if sum(map(len, batch)) > 2 * BLOCK:
        whole = ([b""] * k + [part] for k, x in enumerate(batch) for part in blocks(x.translate(_PART)))
    for rows in whole:
        w = words_of(rows, lower=True)
        docs, out = [w.doc], [mix(w.hash, 11)]
        for n in BEGINNINGS:
            long = w.end - w.start >= n
            docs.append(w.doc[long])
            out.append(mix(w.slice_hash(w.start[long], w.start[long] + n), 20 + n))
        yield np.concatenate(docs), np.concatenate(out), np.bincount(w.doc, minlength=len(batch))


def counted(batch: list[bytes], bits: int, known: np.ndarray | None = None) -> tuple[Sparse, np.ndarray]:
    """Counts of each text's terms (if ``known`` is given, of those alone whose first bits it has), and its words."""
    rows, index, value, words = [], [], [], np.zeros(len(batch), np.int64)
    for doc, f, n in terms(batch):
        f = (f >> np.uint64(64 - bits)).astype(np.int64)
        if known is not None:
            hit = known[f >> (bits - len(known).bit_length() + 1)]
            doc, f = doc[hit], f[hit]
        x = Sparse.of(doc, f, len(batch))
        rows.append(np.repeat(np.arange(x.n), np.diff(x.ptr)))
        index.append(x.index)
        value.append(x.value)
        words += n
    if len(rows) == 1:
        return x, words
    key, at = np.unique(np.concatenate(rows) << 32 | np.concatenate(index), return_inverse=True)
    return Sparse(np.searchsorted(key, np.arange(len(batch) + 1, dtype=np.int64) << 32), key & 0xFFFFFFFF, np.bincount(at, np.concatenate(value), len(key))), words


def levelled(x: Sparse, words: np.ndarray, bits: int) -> Sparse:
    """Each term once, and once more for each further level that its count reaches."""
    row = np.repeat(np.arange(x.n), np.diff(x.ptr))
    reached = [(x.value >= n) & ((x.value * among >= words[row]) | (among == 0)) for n, among in LEVELS]
    rows = [row[ok] for ok in reached]
    index = [x.index[ok] | k << bits for k, ok in enumerate(reached)]
    order = np.argsort(np.concatenate(rows), kind="stable")
    row = np.concatenate(rows)[order]
    return Sparse(np.searchsorted(row, np.arange(x.n + 1)), np.concatenate(index)[order].astype(np.int32), np.ones(len(row), np.float32))


def mine(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Terms that mark class 1, strongest first."""
    row = np.repeat(np.arange(x.n), np.diff(x.ptr))
    term, at = np.unique(x.index, return_inverse=True)
    size = len(term)
    ones = np.bincount(at, y[row], size)
    every = np.bincount(at, minlength=size)
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    rate1, rate0 = (ones + 0.1) / n1, (every - ones + 0.1) / n0
    gain = ones * np.log(rate1 / rate0)
    # a chance term of n rows has them all in class 1 with probability about share**n
    share = n1 / (n1 + n0)
    chance = every * np.log(share) + np.log(size)
    ok = (ones >= 3) & (ones >= 0.9 * every) & (chance < 0)
    found = np.flatnonzero(ok)
    return term[found[np.argsort(-gain[found], kind="stable")][:LEXICON]]


def votes(x: Sparse, words: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """(texts, voters) 0 or 1: which voters fire on which texts."""
    order = np.argsort(lexicon)
    row, hit = np.repeat(np.arange(x.n), np.diff(x.ptr)), np.isin(x.index, lexicon)
    row, at = row[hit], order[np.searchsorted(lexicon[order], x.index[hit])]
    out = np.zeros((x.n, VOTERS), np.int8)
    out[row, np.where(at < OWN, at, OWN + at % DEALT)] = 1
    kinds = np.bincount(row, minlength=x.n)
    for k, pattern in enumerate((kinds >= 2, kinds >= 4, kinds >= 8, kinds * 100 > words, kinds == 0)):
        out[:, OWN + DEALT + k] = pattern
    return out


def voter_weights(own: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each voter 1 over one plus the sizes of its residual correlations with the others within a
    class, from votes on rows of known class; those that chance makes are none."""
    n, m = own.shape
    vf = own.astype(np.float64)
    residue = vf - np.where(y[:, None] > 0.5, vf[y > 0.5].mean(0) if (y > 0.5).any() else 0, vf[y <= 0.5].mean(0) if (y <= 0.5).any() else 0)
    norm = np.sqrt((residue**2).mean(0)) if n else np.ones(m)
    corr = np.abs(residue.T @ residue / max(n, 1) / np.outer(norm + 1e-9, norm + 1e-9))
    np.fill_diagonal(corr, 0)
    corr[corr < max(0.1, 3 / np.sqrt(max(n, 1)))] = 0
    return 1 / (1 + corr.sum(1))


def posterior(v: np.ndarray, weight: np.ndarray, rates: np.ndarray | None, share: float) -> np.ndarray:
    """Chance of class 1 by the votes alone: log-ratios of the voters' rates, each by its weight.
    Without rates a start, by which voters fire more on class 1, but the last, which fires where no term is."""
    vf = v.astype(np.float64)
    if rates is None:
        return np.clip(np.where(v[:, -1] == 1, 0.01, 0.5 + 0.1 * vf[:, :-1].sum(1)), 0.01, 0.99)
    on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
    return sigmoid(np.log(share / (1 - share)) + (vf * (weight * on) + (1 - vf) * (weight * off)).sum(1))


def vote_sums(v: np.ndarray, y: np.ndarray, count: np.ndarray, weight: np.ndarray, rates: np.ndarray | None, share: float) -> np.ndarray:
    """(2, voters + 1): by class, how often each voter fired, and rows. A row counts ``count`` times,
    with its label ``y`` (not a number: none) or else its posterior."""
    t = np.where(np.isnan(y), posterior(v, weight, rates, share), y)
    rows = np.concatenate((v, np.ones((len(v), 1), v.dtype)), 1).astype(np.float64)
    return np.stack((((1 - t) * count) @ rows, (t * count) @ rows))


def settle(sums_of, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Firing rates by class (2, voters) and the share of class 1: ``sums_of(rates, share)`` gives
    ``vote_sums`` of all rows, until rates change no more. Rates are rounded, so that the order in
    which sums come is of no effect."""
    rates, share = None, 0.5
    for _ in range(rounds):
        sums = sums_of(rates, share)
        new = np.round((sums[:, :-1] + 0.05) / (sums[:, -1:] + 0.1), 12)
        share = float(np.round(np.clip(sums[1, -1] / max(sums[:, -1].sum(), 1), 0.001, 0.5), 12))
        done, rates = rates is not None and np.abs(new - rates).max() < SETTLED, new
        if done:
            break
    return rates, share


def label_model(v: np.ndarray, known: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, firing rates by class (2, voters) and effective weights of the voters,
    from votes at hand. Rows ``known`` count with their label ``y`` where rates are
    estimated, so the classes keep their meaning; every row's posterior comes from the
    votes alone."""
    labels = np.full(len(v), np.nan)
    labels[known] = y
    weight = voter_weights(v[known], y)
    rates, share = settle(lambda r, s: vote_sums(v, labels, np.ones(len(v)), weight, r, s), rounds)
    return posterior(v, weight, rates, share), rates, weight


def vote_patterns(docs: DataFrame, ids: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """(pattern, y, count) over every whole text of ``docs``: which voters fire, as bits, and the label of
    rows of ``ids`` (doc_id, y), which are bounded in number. Counts are added before they part."""
    bounded_batches(docs.sparkSession)
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[(lexicon & ((1 << FINE) - 1)) >> (FINE - SIEVE)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.encode() for t in texts(batch)]
            bits = [np.zeros((0, -(-VOTERS // 8)), np.uint8)]
            for _, part in by_size(data, len, CHUNK):
                x, words = counted(part, FINE, sieve)
                bits.append(np.packbits(votes(levelled(x, words, FINE), words, lexicon), axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in np.concatenate(bits)], pa.binary())], names=["doc_id", "pattern"])

    told = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, pattern binary")
    return told.join(F.broadcast(ids), "doc_id", "left").groupBy("pattern", "y").count()


def corpus_rates(patterns: DataFrame, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """``settle`` over a table of ``vote_patterns``: each round is a pass over it, of which the driver
    gets a sum a task."""

    def sums_of(rates: np.ndarray | None, share: float) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, VOTERS + 1))
            for batch in batches:
                if len(batch):
                    v = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(batch), -1), axis=1, count=VOTERS)
                    y = np.array([np.nan if k is None else k for k in batch.column(1).to_pylist()], np.float64)
                    sums += vote_sums(v, y, batch.column(2).to_numpy(), weight, rates, share)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        got = [np.frombuffer(r.sums).reshape(2, -1) for r in patterns.mapInArrow(run, "sums binary").collect()]
        return np.sum([np.zeros((2, VOTERS + 1)), *got], axis=0)

    return settle(sums_of, rounds)


def _presence(rows: list[bytes], bits: int = FINE) -> tuple[Sparse, np.ndarray]:
    parts, words = [], []
    for _, part in by_size(rows, len, CHUNK):
        x, n = counted(part, bits)
        parts.append(levelled(x, n, bits))
        words.append(n)
    return joined(parts), np.concatenate(words)


def _read(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
    """Bounded rows (doc_id, y, text) in an order of their own."""
    got = []
    for batch in batches:
        got += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [t.encode() for t in texts(batch)], strict=True)
    return sorted(got, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))


def voters(known: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Lexicon and weights of the voters, mined from labelled rows (doc_id, y, text): one task, as the rows
    are bounded in number. None without a row of label 1."""
    bounded_batches(known.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _read(batches)
        y = np.array([r[1] for r in got], np.float64)
        if y.sum():
            x, words = _presence([r[2] for r in got])
            lexicon = mine(x, y)
            weight = voter_weights(votes(x, words, lexicon), y)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes()], pa.binary()) for k in (lexicon.astype(np.int64), weight)], names=["lexicon", "weight"])

    got = known.repartition(1).mapInArrow(run, "lexicon binary, weight binary").first()
    return got and (np.frombuffer(got["lexicon"], np.int64), np.frombuffer(got["weight"]))


def train(rows: DataFrame, lexicon: np.ndarray, weight: np.ndarray, rates: np.ndarray, share: float, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not zero, the bias last, learnt from the label model's
    posteriors of (doc_id, y, text): one task, as the rows are bounded in number."""
    bounded_batches(rows.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _read(batches)
        if not got:
            return
        x, words = _presence([r[2] for r in got])
        p = posterior(votes(x, words, lexicon), weight, rates, share)
        x.index = x.index >> (FINE - bits)
        w = ftrl(x, p, len(LEVELS) << bits, alpha=0.3, l1=0.5, l2=0.0, epochs=3)
        at = np.union1d(np.flatnonzero(w), [len(w) - 1])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int64), w[at])], names=["at", "w"])

    got = rows.repartition(1).mapInArrow(fit, "at binary, w binary").first()
    return (np.frombuffer(got["at"], np.int64), np.frombuffer(got["w"])) if got else no_model(bits)


def no_model(bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Without a row of label 1 nothing is toxic: a low bias alone."""
    return np.array([len(LEVELS) << bits]), np.array([-6.0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """(doc_id, score): the sum of the weights of a whole text's different terms."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = held.value
        known = np.zeros(1 << bits, bool)
        known[at[:-1] & ((1 << bits) - 1)] = True
        for batch in batches:
            data = [t.encode() for t in texts(batch)]
            z = np.full(len(data), w[-1])
            for first, part in by_size(data, len, CHUNK):
                x = levelled(*counted(part, bits, known), bits)
                place = np.minimum(np.searchsorted(at, x.index), len(at) - 1)
                row = np.repeat(np.arange(x.n), np.diff(x.ptr))
                z[first : first + len(part)] += np.bincount(row, np.where(at[place] == x.index, w[place], 0), x.n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(z))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = LABELLED, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Labels are read only where crc32(doc_id as text) mod 3 is not 1. Null and empty
    texts score by the bias. Rows with a null doc_id are scored and never learnt
    from. Repeated rows stay rows. Extra columns are not read.
    """
    known = labelled(docs, labels, "toxic", FOLDS, HELD_OUT, sample)
    known = stash(known.select("doc_id", F.col("y").cast("int").alias("y"), "text"), "labelled")
    found, w = voters(known), no_model()
    if found:
        lexicon, weight = found
        patterns = stash(vote_patterns(docs, known.select("doc_id", "y").distinct(), lexicon), "patterns")
        rates, share = corpus_rates(patterns, weight)
        other = bounded_sample(docs.where("doc_id is not null").select("doc_id"), "doc_id", unlabelled)
        other = docs.join(F.broadcast(other.distinct()), "doc_id").select("doc_id", F.lit(None).cast("int").alias("y"), "text")
        w = train(known.union(other), lexicon, weight, rates, share)
        discard(patterns)
    discard(known)
    return score(docs, w).select("doc_id", (crc_text("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; see ``toxicity`` for nulls, empty texts and repeated rows."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
