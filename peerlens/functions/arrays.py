"""Array expressions with the null rules that the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """Sum of the non-null elements; 0 for an empty array, null for null."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


def has_repeats(values: Column) -> Column:
    """Whether two elements are equal; false for an empty array."""
    return F.size(F.array_distinct(values)) < F.size(values)


def contains(values: Column, item: Column) -> Column:
    """Membership that is false, not null, when the array holds nulls and no match."""
    return F.coalesce(F.array_contains(values, item), F.lit(False))


def arg_max(values: Column) -> Column:
    """0-based position of the first largest element, nulls read as 0; -1 if empty."""
    filled = F.transform(values, lambda x: F.coalesce(x, F.lit(0)))
    return F.coalesce(F.array_position(filled, F.array_max(filled)) - 1, F.lit(-1)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def paired(addresses: str, amounts: str) -> Column:
    """Array of (address, sats) by position; a null or short amount list pads with null."""
    filled = F.coalesce(F.col(amounts), F.array().cast("array<bigint>"))
    return F.arrays_zip(F.col(addresses).alias("address"), filled.alias("sats"))
