"""Vector and fusion scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine to one known query: unrolled over its components, so it is compiled and not interpreted."""
    at = [F.get(vector, F.lit(i)).cast("double") for i in range(len(query))]
    norm = sum(q * q for q in query) ** 0.5
    products = reduce(lambda s, x: s + x, [x * float(q) for x, q in zip(at, query, strict=True)])
    squares = reduce(lambda s, x: s + x, [x * x for x in at])
    return F.try_divide(products, F.sqrt(squares) * norm)


def clamped(score: Column) -> Column:
    """Into 0 to 1; null and non-finite scores are 0."""
    x = score.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def rrf(rank: Column) -> Column:
    """One branch's share of the reciprocal-rank score, at most a half."""
    return F.lit(1.0) / (RRF_K + rank) / F.lit(2.0 / (RRF_K + 1))
