"""The N best items of every group (problem 3).

Each partition keeps, per group, its own N best distinct items. Its N-th best
score is a lower bound of the group's N-th best score. The largest bounds are
joined to the kept rows where they lie, rows below them are dropped before any
row is exchanged, and the few survivors of a group are ranked. Bounds only help
groups that several partitions hold; they go out by broadcast, 16 bytes a group,
from the most widely held groups down, as many as ``BOUNDS`` allows. The ranking
takes whatever rows remain, so this decides about work and never about results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from peerlens.runtime import durable

# Rows gathered in a partition before they are reduced to the N best per group.
COMPACT_ROWS = 200_000
# Groups whose bounds may be broadcast (16 bytes each).
BOUNDS = 500_000


def _best(frame: pd.DataFrame, keys: list[str], item: str, score: str, n: int) -> pd.DataFrame:
    """N best distinct items per group: score descending, item ascending."""
    ordered = frame.sort_values([score, item], ascending=[False, True], kind="stable")
    ordered = ordered.drop_duplicates([*keys, item])
    return ordered[ordered.groupby(keys, sort=False, dropna=False).cumcount() < n]


def top_n(rows: DataFrame, keys: list[str], item: str, score: str, n: int = 3, place: str = "place") -> DataFrame:
    """(keys..., item, place): the n items with the largest score of each group.

    Null and NaN scores and null items never count; an item listed more than once
    counts once, with its largest score; equal scores go by item ascending (by
    code point). Rows with a null group key are left out. A group with fewer than
    n items gives fewer rows; an empty table gives none. Other columns are ignored.
    """
    cond = F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    # adding 0.0 makes -0.0 equal to 0.0
    slim = rows.where(cond).select(F.xxhash64(*keys).alias("_mark"), *keys, item, (F.col(score).cast("double") + F.lit(0.0)).alias("_score"))
    schema = StructType([*slim.schema.fields, StructField("_bound", DoubleType())])

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        held: list[pd.DataFrame] = []
        waiting = 0
        for frame in frames:
            held.append(frame)
            waiting += len(frame)
            # the limit doubles with what is kept, so reducing stays linear in the rows
            if waiting >= max(COMPACT_ROWS, 0 if kept is None else len(kept)):
                kept = _best(pd.concat([*([] if kept is None else [kept]), *held]), keys, item, "_score", n)
                held, waiting = [], 0
        if held:
            kept = _best(pd.concat([*([] if kept is None else [kept]), *held]), keys, item, "_score", n)
        if kept is not None and len(kept):
            grouped = kept.groupby(keys, sort=False)["_score"]
            bound = grouped.transform("min").where(grouped.transform("size") == n)
            kept = kept.assign(_bound=bound)
            for at in range(0, len(kept), 50_000):
                yield kept.iloc[at : at + 50_000]

    kept = durable(slim.mapInPandas(local, schema), "local-best")
    held = kept.where(F.col("_bound").isNotNull()).groupBy("_mark", *keys).agg(F.max("_bound").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    # two groups with one mark share the smaller bound, which holds for both
    bounds = durable(held.where(F.col("_rows") > n).groupBy("_mark").agg(F.min("_least").alias("_least"), F.max(F.ceil(F.log2(F.col("_rows") / n))).alias("_width")), "bounds")
    widths = sorted((r["_width"], r["n"]) for r in bounds.groupBy("_width").agg(F.count(F.lit(1)).alias("n")).collect())
    while widths and sum(many for _, many in widths) > BOUNDS:
        widths.pop(0)
    survivors = kept
    if widths:
        known = F.broadcast(bounds.where(F.col("_width") >= widths[0][0]).select("_mark", "_least"))
        survivors = kept.join(known, "_mark", "left").where(F.col("_least").isNull() | (F.col("_score") >= F.col("_least")))
    # one exchange by group serves the distinct items and their ranks
    survivors = survivors.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))), *keys)
    single = survivors.groupBy(*keys, item).agg(F.max("_score").alias("_score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_score"), F.asc(item))
    return single.withColumn(place, F.row_number().over(w).cast("long")).where(F.col(place) <= n).select(*keys, item, place)
