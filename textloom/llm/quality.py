"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse dot products.

Features are hashed to ``2**BITS`` buckets: words, word pairs, and one to three
word shapes in a row. A shape keeps letter case, digits and punctuation by class,
and tells a word that repeats the one before. Values are counts over the number
of features of the text, times a constant, so a score tells what the text is like
throughout, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, bounded_sample, by_size, crc_text, in_arrow, table, texts
from ._linear import Sparse, ftrl, joined, sigmoid
from ._words import BLOCK, blocks, mix, shapes_of, words_of

BITS = 20
SCALE = 16.0
SAMPLE = 8_000  #: most labelled rows that fit the model, by hash of doc_id
FOLDS, HELD_OUT = 4, 2
LIMIT = 0.7  #: predicted is 1 from this score on
CHUNK = 1 << 20
WORDS = 1 << 18  #: words whose features are held together


def _words(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and shape of every word; long texts go by blocks."""
    if sum(map(len, batch)) <= 2 * BLOCK:
        w = words_of(batch)
        return w.doc, w.hash, shapes_of(w)
    got = []
    for k, t in enumerate(batch):
        for part in blocks(t):
            w = words_of([part])
            got.append((w.doc + k, w.hash, shapes_of(w)))
    return tuple(np.concatenate(x) for x in zip(*got))


def feature_parts(batch: list[bytes], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) pairs of a batch, repeats included, by ``WORDS`` words at most."""
    d, h, s = _words(batch)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    s = np.where(same, ~s, s)
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    for at in range(0, len(h), WORDS):
        end = min(at + WORDS, len(h))
        d1, h1, s1 = d[at:end], h[at:end], s[at:end]
        d2, h2, s2 = (x[max(at - 1, 0) : end] for x in (d, h, s))
        d3, s3 = (x[max(at - 2, 0) : end] for x in (d, s))
        two, three = d2[1:] == d2[:-1], d3[2:] == d3[:-2]
        parts = [
            (d1, mix(h1, 1)),
            (d2[1:][two], mix(h2[1:] * k1 + h2[:-1] * k2, 2)[two]),
            (d1, mix(s1, 3)),
            (d2[1:][two], mix(s2[1:] * k1 + s2[:-1] * k2, 4)[two]),
            (d3[2:][three], mix(s3[2:] * k1 + s3[1:-1] * k2 + s3[:-2] * k3, 5)[three]),
        ]
        yield np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]) >> np.uint64(64 - bits)


def features(batch: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``feature_parts`` together."""
    parts = list(feature_parts(batch, bits)) or [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])


def scores(data: list[bytes], w: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The score of each text: a sparse dot product with the weights, whose last is the bias."""
    out = np.zeros(len(data))
    for at, part in by_size(data, len, CHUNK):
        sums, count = np.zeros(len(part)), np.zeros(len(part))
        for doc, f in feature_parts(part, bits):
            sums += np.bincount(doc, w[f], len(part))
            count += np.bincount(doc, minlength=len(part))
        out[at : at + len(part)] = sums * (SCALE / np.maximum(count, 1))
    return sigmoid(out + w[-1])


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled rows outside the held-out fold, by
    hash of doc_id. Null labels are none; a doc_id with several labels has the largest.
    The ids are ``most`` at most, so they go to the documents, not these to them."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_text("doc_id") % folds != held_out)).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = bounded_sample(ids, "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")


def train(rows: DataFrame, bits: int = BITS) -> np.ndarray:
    """Weights from (doc_id, y, text): one task, as the rows are bounded in number.
    Without rows, or of one label alone: zero weights and the bias of that label."""
    bounded_batches(rows.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, xs = [], [], []
        for batch in batches:
            data = [t.encode() for t in texts(batch)]
            ids += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
            for _, part in by_size(data, len, CHUNK):
                doc, f = features(part, bits)
                x = Sparse.of(doc, f, len(part))
                x.value = (x.value * np.repeat(SCALE / np.maximum(np.bincount(doc, minlength=len(part)), 1), np.diff(x.ptr))).astype(np.float32)
                x.index = x.index.astype(np.int32)
                xs.append(x)
        if not ids:
            return
        order = np.argsort(np.array(ids), kind="stable")
        x = joined(xs)
        y = np.array(ys, np.float64)
        del xs
        rows_ = [(x.index[x.ptr[k] : x.ptr[k + 1]], x.value[x.ptr[k] : x.ptr[k + 1]]) for k in order]
        x = Sparse(np.concatenate(([0], np.cumsum([len(i) for i, _ in rows_]))), np.concatenate([i for i, _ in rows_]), np.concatenate([v for _, v in rows_]))
        w = ftrl(x, y[order], 1 << bits, alpha=1.0, l1=0.02, l2=0.0, epochs=2)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], names=["w"])

    got = in_arrow(rows.repartition(1), fit, "w binary").first()
    return np.frombuffer(got["w"], np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row: a sparse dot product of its whole text with the weights."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.astype(np.float64)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores([t.encode() for t in texts(batch)], w, bits))], names=["doc_id", "score"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Labels are read only where crc32(doc_id as text) mod 4 is not 2. A null or empty
    text has no features and scores by the bias; rows with a null doc_id are scored
    and never learnt from. Repeated rows stay rows. Extra columns are not read.
    """
    w = train(labelled(docs, labels, "quality", FOLDS, HELD_OUT, sample))
    return score(docs, w).select("doc_id", (crc_text("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier does not predict as good go.

    Scores stay beside the text: the filter runs in the same pass, without a join."""
    w = train(labelled(docs, table(spark, sf_dir, "labels"), "quality", FOLDS, HELD_OUT, SAMPLE))
    held = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.astype(np.float64)
        for batch in batches:
            data = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(scores([t.encode() for t in data], w) >= LIMIT))

    return in_arrow(docs, run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; see ``classify`` for nulls, empty texts and repeated rows."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
