"""Vector and set similarity on array columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: reuse tiers ----
NEAR_DUPLICATE = 0.95
SAME_FAMILY = 0.65
OVERLAP = 0.4


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two equal-length arrays; 0 when either has no length."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, F.try_divide(dot(a, b), size)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets without repeats; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, F.try_divide(shared.cast("double"), total)).otherwise(0.0)


def tier(score: Column) -> Column:
    """Reuse tier of an unrounded score; null means there was no family to score."""
    return (F.when(score.isNull(), "no-families")
            .when(score >= NEAR_DUPLICATE, "near-duplicate")
            .when(score >= SAME_FAMILY, "same-family")
            .otherwise("unrelated"))
