"""Maximum inner product search: score-aware quantisation, table scans, exact reranking.

Vectors are scaled to unit length, so the inner product is the cosine. A product
quantiser with 16 centroids (four bits) per two components is fitted on a bounded
sample with the anisotropic loss: the part of the residual parallel to the vector,
which changes inner products with the queries that matter, weighs ``eta`` times
the rest. Every row is then encoded, a task holds the codes of a stripe of rows and
lets the queries walk past, each scanning the stripe by table lookups. The best
candidates are scored on the original vectors, which lie beside the codes; so is every
other row whose code and distance from it leave room for a place among the nearest.
Where codes tell too little (that room is over an eighth of the stripe) the query is
compared with all vectors of the stripe by a matrix product. No nearest row is lost.

Equal vectors are one entry of the index with their smallest ids, so a vector
that a third of all rows share fills one candidate's place and one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nearest import Nearest
from ._common import BATCH_ROWS, bounded_batches, bounded_sample, in_arrow, stash, table

SAMPLE = 20_000  #: rows that fit the quantiser, by hash of the id
DSUB, CENTROIDS = 2, 16
STRIPE_BYTES = 64 << 20  #: codes, vectors and ids that one task holds
PACK = 64  #: queries that travel as one row
RERANK = 256  #: candidates per query and stripe that say how near the nearest are at least
OPEN = 8  #: a query with more than this part of a stripe left is compared with all of it


def _assign(x: np.ndarray, books: np.ndarray, eta: float, passes: int = 3) -> np.ndarray:
    """Codes (n, m) by coordinate descent on the anisotropic loss of unit vectors x."""
    n, m = len(x), len(books)
    parts = x.reshape(n, m, DSUB)
    dist = ((parts[:, :, None, :] - books[None]) ** 2).sum(-1)
    par = np.einsum("nmd,mkd->nmk", parts, books)
    own = (parts**2).sum(-1)
    codes = dist.argmin(-1)
    rows = np.arange(n)
    total = np.take_along_axis(par, codes[:, :, None], 2)[:, :, 0] - own  # parallel residual by subspace
    s = total.sum(1)
    for _ in range(passes):
        for j in range(m):
            rest = s - total[:, j]
            cost = dist[:, j] + (eta - 1) * (rest[:, None] + par[:, j] - own[:, j, None]) ** 2
            codes[:, j] = cost.argmin(1)
            total[:, j] = par[rows, j, codes[:, j]] - own[:, j]
            s = rest + total[:, j]
    return codes


def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 0) -> tuple[np.ndarray, float]:
    """Codebooks (m, 16, dsub) and eta for unit vectors x: assignment and an exact
    least-squares update of all centroids at once, in turn. The inner products
    above ``threshold`` are those that matter."""
    n, d = x.shape
    m = d // DSUB
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, m, DSUB)
    books = np.stack([parts[rng.choice(n, CENTROIDS, replace=n < CENTROIDS), j] for j in range(m)]).astype(np.float64)
    for r in range(rounds):
        codes = _assign(x, books, 1.0 if r < rounds // 2 else eta)
        w = 0.0 if r < rounds // 2 else eta - 1
        size = m * CENTROIDS * DSUB
        a, b = np.zeros((size, size)), np.zeros(size)
        col = ((np.arange(m) * CENTROIDS + codes) * DSUB)[:, :, None] + np.arange(DSUB)
        col = col.reshape(n, d)
        np.add.at(a, (col, col), 1.0)
        np.add.at(b, col, x)
        if w:
            for i in range(d):
                np.add.at(a, (col[:, i : i + 1], col), w * x[:, i : i + 1] * x)
            np.add.at(b, col, w * x * (x**2).sum(1, keepdims=True))
        a[np.diag_indices(size)] += 1e-6
        b += 1e-6 * books.reshape(-1)
        books = np.linalg.solve(a, b).reshape(m, CENTROIDS, DSUB)
    return books, eta


def encode(x: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Two codes to a byte: (n, m / 2), the even subspace in the low half."""
    out = []
    for k in range(0, len(x), 2048):
        c = _assign(x[k : k + 2048], books, eta).astype(np.uint8)
        if c.shape[1] % 2:
            c = np.pad(c, ((0, 0), (0, 1)))
        out.append(c[:, 0::2] | c[:, 1::2] << 4)
    return np.concatenate(out) if out else np.zeros((0, (len(books) + 1) // 2), np.uint8)


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(bytes, 256) lookup table of one query: each byte's two partial inner products."""
    t = np.einsum("md,mkd->mk", q.reshape(len(books), DSUB), books)
    if len(t) % 2:
        t = np.vstack((t, np.zeros(CENTROIDS)))
    return (t[0::2, None, :] + t[1::2, :, None]).reshape(-1, 256).astype(np.float32)


def scan(codes: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Approximate inner product of every code; ``codes`` is (bytes, n)."""
    out = table_[0][codes[0]]
    for j in range(1, len(table_)):
        out += table_[j][codes[j]]
    return out


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes (n, bytes) stand for."""
    c = np.stack((codes & 15, codes >> 4), 2).reshape(len(codes), -1)[:, : len(books)]
    return books[np.arange(len(books)), c].reshape(len(codes), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if len(scores) > k:
        at = np.argpartition(-scores, k - 1)
        bar = scores[at[:k]].min()
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def grid(n: int, width: int, packs: int, cores: int) -> tuple[int, int]:
    """(stripes, blocks): as few stripes as memory allows, for every query goes to each
    and brings candidates back; then blocks of queries until all cores have a cell. Codes
    are sent once per block: at most ``cores`` times, however many rows and queries there are."""
    stripes = max(1, -(-n * (width + 8) // STRIPE_BYTES))
    return stripes, max(1, min(packs, -(-cores // stripes)))


def _matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix in double precision) of the vectors that take part."""
    v = column.to_pylist()
    dim = dim or next((len(x) for x in v if x), 0)
    at = [k for k, x in enumerate(v) if x is not None and len(x) == dim and None not in x]
    m = np.array([v[k] for k in at], np.float64).reshape(len(at), dim)
    ok = np.isfinite(m).all(1) & (m != 0).any(1) if dim else np.zeros(len(at), bool)
    return np.array(at, np.int64)[ok], m[ok]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in component order (the same bits in any batch)."""
    ab, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        ab += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return ab / (np.sqrt(aa) * np.sqrt(bb))


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows by cosine of each row whose id is divisible by ``every``:
    query_id, rank (from 1), vec_id, score, nearest first, ties to smaller ids.

    A query's own row is no candidate; another row with an equal vector is. Vectors
    null, of zero length, holding null or non-finite components, or of another
    dimension than the table's most frequent one take no part, nor do rows
    without an id. Rows that repeat an id with an equal vector count once. Fewer than ``k`` candidates: all of
    them. An empty table gives an empty result. Extra columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    pad = (-dim) % DSUB

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal vectors of a partition as one row with their k + 1 smallest ids: pre-aggregation
        seen: dict[bytes, list] = {}

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([sorted(set(x))[: k + 1] for x in seen.values()], pa.list_(pa.int64()))], names=["v", "ids"])

        for batch in batches:
            at, m = _matrix(batch.column(1), dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            m = m + 0.0  # one zero
            for i, x in zip(ids.tolist(), m, strict=True):
                seen.setdefault(x.tobytes(), []).append(i)
            for key, x in seen.items():
                if len(x) > 64:
                    seen[key] = sorted(set(x))[: k + 1]
            if len(seen) > 50_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    parts = rows.mapInArrow(grouped, "v binary, ids array<bigint>")
    entries = parts.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = stash(entries.select(F.element_at("ids", 1).alias("entry"), "ids", "v"), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)

    def padded(keys) -> np.ndarray:
        x = _unit(np.frombuffer(b"".join(keys), np.float64).reshape(-1, dim))
        return np.pad(x, ((0, 0), (0, pad)))

    picked = bounded_sample(entries.select("entry", "v"), "entry", sample, n)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [x for batch in batches for x in batch.column(1).to_pylist()]
        if keys:
            books, eta = fit(padded(keys))
            yield pa.RecordBatch.from_arrays([pa.array([books.tobytes()], pa.binary()), pa.array([eta])], names=["books", "eta"])

    model = picked.coalesce(1).mapInArrow(fitted, "books binary, eta double").first()
    books, eta = np.frombuffer(model["books"]).reshape(-1, CENTROIDS, DSUB), model["eta"]

    width = len(books) // 2 + len(books) % 2
    # vectors travel as wide as the table has them
    element = vectors.schema[vec_col].dataType.elementType.typeName()
    kept_as = "<f4" if element == "float" else "<f8"
    # Queries are original rows: any row of an entry, not its smallest ids alone.
    asked = rows.where(F.col("id") % every == 0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = _matrix(batch.column(1), dim)
            m = m + 0.0
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy(zero_copy_only=False)[at]), pa.array([x.tobytes() for x in m], pa.binary())], names=["query_id", "q"])

    queries = stash(asked.mapInArrow(keyed, "query_id long, q binary").dropDuplicates(), "queries")
    stripes, blocks = grid(n, width + 8 + dim * int(kept_as[-1]), -(-queries.count() // PACK), spark.sparkContext.defaultParallelism)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch's codes are one row; any row may go to any stripe
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                keys, ids = batch.column(0)[k : k + BATCH_ROWS].to_pylist(), batch.column(1)[k : k + BATCH_ROWS]
                unit, flat = padded(keys), ids.flatten()
                codes = encode(unit, books, eta)
                # how far a code's vector is from the row's own bounds what the scan may be wrong by
                off = (np.sqrt(((unit - decoded(codes, books)) ** 2).sum(1)) * (1 + 1e-6) + 1e-4).astype(np.float32)
                v = np.frombuffer(b"".join(keys), np.float64).astype(kept_as)
                parts = [np.array([len(x) for x in ids.to_pylist()], np.int32), off, codes, v]
                yield pa.RecordBatch.from_arrays([flat.slice(0, 1), *[pa.array([x.tobytes()], pa.binary()) for x in (flat.to_numpy(), *parts)]], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(ids), PACK):
                none = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([ids[k]]), pa.array([ids[k : k + PACK].tobytes()], pa.binary()), none, none, none, pa.array([b"".join(batch.column(1)[k : k + PACK].to_pylist())], pa.binary())], names=names)

    names = ["first", "ids", "counts", "off", "codes", "body"]
    pack = "first long, " + ", ".join(f"{x} binary" for x in names[1:])
    own_stripe, own_block = (F.pmod(F.xxhash64("first"), F.lit(x)) for x in (stripes, blocks))
    every_stripe, every_block = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x - 1).cast("long"))) for x in (stripes, blocks))
    held = entries.select("v", "ids").mapInArrow(encoded, pack).select(own_stripe.alias("stripe"), every_block.alias("block"), F.lit(0).alias("kind"), *names[1:])
    walking = queries.mapInArrow(packed, pack).select(every_stripe.alias("stripe"), own_block.alias("block"), F.lit(1).alias("kind"), *names[1:])
    cells = held.unionByName(walking).withColumn("cell", (F.col("stripe") * blocks + F.col("block")).cast("int"))
    # the codes of a cell come first: a task holds one stripe and one pack of queries
    cells = cells.repartitionById(stripes * blocks, F.col("cell")).sortWithinPartitions("cell", "kind").select("cell", "kind", *names[1:])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, kept, stripe = None, [], None
        for batch in batches:
            for c, kind, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != cell:
                    cell, kept, stripe = c, [], None
                if not kind:
                    kept.append(row)
                    continue
                if stripe is None:
                    whole = [b"".join(x) for x in zip(*kept, strict=True)] or [b""] * 5
                    kept = []
                    stripe = _Stripe(*whole, width, dim, kept_as)
                if not len(stripe.codes[0]):
                    continue
                query_ids, q = np.frombuffer(row[0], np.int64), np.frombuffer(row[4], np.float64).reshape(-1, dim)
                of, ids, far = stripe.nearest(query_ids, q, padded([row[4]]), books, k, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[of]), pa.array(-far), pa.array(ids)], names=["query_id", "score", "vec_id"])

    spread = in_arrow(cells, scanned, "query_id long, score double, vec_id long")
    order = F.expr("array_sort(collect_list(struct(-score as far, vec_id)))")
    top = spread.distinct().groupBy("query_id").agg(F.slice(order, 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.far")).alias("score"))


class _Stripe:
    """Codes, original vectors and ids of the entries that a task holds."""

    def __init__(self, ids: bytes, counts: bytes, off: bytes, codes: bytes, body: bytes, width: int, dim: int, kept_as: str):
        self.ids, self.counts, self.off = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32), np.frombuffer(off, np.float32)
        self.codes = np.frombuffer(codes, np.uint8).reshape(-1, width).T.copy()
        self.v = np.frombuffer(body, kept_as).reshape(-1, dim)
        self.at = np.r_[0, np.cumsum(self.counts, dtype=np.int64)]  # where each entry's ids begin

    def rows(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, vectors) of all rows of some entries."""
        n = self.counts[entries]
        places = np.repeat(self.at[entries] - np.r_[0, np.cumsum(n, dtype=np.int64)[:-1]], n) + np.arange(n.sum())
        return self.ids[places], np.repeat(self.v[entries].astype(np.float64), n, axis=0)

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, unit: np.ndarray, books: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of queries, ids, cosines negated) of each query's k nearest rows, its own left out."""
        near = Nearest(q, k, "angle", own=query_ids)
        first, wide = self.ids[self.at[:-1]], []
        for j, x in enumerate(unit):
            s = scan(self.codes, tables(x, books))
            sure = best(s, first, max(rerank, k + 1))
            near.pairs(*self.rows(sure), j)
            left = np.setdiff1d(np.flatnonzero(s + self.off >= -near.worst[j]), sure)
            if len(left) * OPEN > len(s):
                wide.append(j)
                continue
            for a in range(0, len(left), 4_096):
                near.pairs(*self.rows(left[a : a + 4_096]), j)
        of, ids, far = near.found()
        if not wide:
            return of, ids, far
        rest = Nearest(q[wide], k, "angle", own=query_ids[wide])
        for a in range(0, len(first), 8_192):
            rest.add(*self.rows(np.arange(a, min(a + 8_192, len(first)))))
        keep = ~np.isin(of, wide)
        more = rest.found()
        return np.r_[of[keep], np.array(wide)[more[0]]], np.r_[ids[keep], more[1]], np.r_[far[keep], more[2]]


def op1_scann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each query; see ``search`` for vectors that take no part, ties and repeated rows."""
    return search(table(spark, sf_dir, "embeddings"))


#: Exact answer, summed in component order in double precision.
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS len FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.len * c.len) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
