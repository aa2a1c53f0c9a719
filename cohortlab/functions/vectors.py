"""Similarity of vectors held as array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortlab.constants import COSINE_EPS


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; a zero vector gives 0. Pass norms known beforehand."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return dot(a, b) / F.greatest(size, F.lit(COSINE_EPS))


def two_way_softmax(present: Column, absent: Column) -> Column:
    """First entry of softmax([present, absent])."""
    return 1 / (1 + F.exp(absent - present))
