"""Schema keywords as predicates: true where the value breaks the rule."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def breaks_type(kind: Column, types: Column, whole: Column | None = None) -> Column:
    """``types`` is an array; an integer also counts as a number, and so does a number
    without a fraction, like 1e2 or 2.0, as an integer (``whole``)."""
    fits = F.array_contains(types, kind) | ((kind == "integer") & F.array_contains(types, F.lit("number")))
    if whole is not None:
        fits = fits | (whole & F.array_contains(types, F.lit("integer")))
    return types.isNotNull() & ~fits


def missing_fields(keys: Column, required: Column) -> Column:
    return F.array_except(required, keys)


def extra_fields(keys: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_except(keys, allowed))


def breaks_enum(item: Column, allowed: Column) -> Column:
    """``allowed`` holds JSON texts."""
    return allowed.isNotNull() & ~F.array_contains(allowed, item)


def breaks_pattern(value: Column, pattern: str) -> Column:
    """Unanchored search, as the keyword is defined."""
    return ~value.rlike(pattern)


def shorter_than(value: Column, minimum: Column) -> Column:
    return F.length(value) < minimum
