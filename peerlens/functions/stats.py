"""Aggregate expressions with explicit null and order rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_with_null(value: Column) -> Column:
    """Exact distinct count in which null counts as one value."""
    return F.count_distinct(value) + F.max(F.when(value.isNull(), 1).otherwise(0))


def first_by(value: Column, order: Column) -> Column:
    """First non-null value in the given order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def share(condition: Column) -> Column:
    """Share of rows with a true condition; null conditions are not counted."""
    return F.avg(condition.cast("int"))


def truncated_median(value: Column) -> Column:
    """Exact median, cut to a whole number."""
    return F.median(value).cast("bigint")


def variation(value: Column) -> Column:
    """Sample standard deviation over mean; null for one value or a zero mean."""
    return F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))


def majority(value: Column) -> Column:
    """Whether more than half of all rows are true; ties are false."""
    return F.lit(2) * F.sum(value.cast("int")) > F.count(F.lit(1))
