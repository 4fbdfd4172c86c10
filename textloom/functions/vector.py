"""Column expressions over vectors (array<float>), summed in double precision in
component order, so they agree with any engine that does the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot")


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def distance(a: Column | str, b: Column | str, metric: str = "l2", squared: bool = True) -> Column:
    """Smaller is nearer: squared L2 (or L2), one minus cosine, or minus the dot product."""
    if metric == "l2":
        return l2(a, b) if squared else F.sqrt(l2(a, b))
    if metric == "cosine":
        size = norm(a) * norm(b)
        return F.lit(1.0) - F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"metric {metric!r} is none of {METRICS}")


def score(d: Column) -> Column:
    """A distance as a score: 1 / (1 + d)."""
    return F.lit(1.0) / (F.lit(1.0) + d)
