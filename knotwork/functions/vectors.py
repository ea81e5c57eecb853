"""Vector expressions in double precision; null and zero vectors count as not embedded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; null for a zero vector. Pass precomputed norms for pairwise work."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return 1 - F.try_divide(dot(a, b), size)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def parsed(text: Column) -> Column:
    """A vector from its text form ``[0.1, 0.2]``."""
    return F.from_json(text, "array<float>")


def embedded(v: Column) -> Column:
    """Not null, not zero, and without null, NaN or infinite components."""
    return v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def or_zero(v: Column, dim: int) -> Column:
    return F.coalesce(v, F.array_repeat(F.lit(0.0).cast("float"), dim))


def has_dim(v: Column, dim: int) -> Column:
    return F.size(v) == dim
