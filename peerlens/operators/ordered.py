"""Values carried along the order of a group, also where one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.runtime import durable, hot_keys


def _ranges(rows: DataFrame, keys: list[str], order: list[Column], range_rows: int) -> DataFrame:
    """``rows`` written in ranges of about ``range_rows`` rows, with ``_part`` (range) and ``_at`` (order)."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows.count() // range_rows))
    by = [*[F.col(k).asc() for k in keys], *order]
    ranged = durable(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    return ranged.withColumn("_part", F.shiftright("_at", 33).cast("int"))


def last_before(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, strict: bool = False, hot_rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``out``: the last non-null ``value`` up to (``strict``: before) each row of its group.

    ``order`` are sort orders that leave no ties that matter. Groups of ordinary
    size take one window. The rows of groups with more than ``hot_rows`` rows are
    range-partitioned by group and order instead, a window runs inside each range,
    and what a range ends with is handed on to the next one: one small row per
    range goes over the driver. Null keys form groups like others. An empty table
    gives an empty result.
    """
    upto = Window.unboundedPreceding, -1 if strict else 0
    plain = lambda rows: rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))
    hot = hot_keys(df, keys, least=hot_rows)
    if hot is None:
        return plain(df)
    marked = df.withColumn("_mark", F.xxhash64(*keys)).join(F.broadcast(hot.drop("_salts").withColumn("_hot", F.lit(True))), "_mark", "left").drop("_mark")
    few = plain(marked.where(F.col("_hot").isNull()).drop("_hot"))
    many = marked.where(F.col("_hot")).drop("_hot")
    ranged = _ranges(many, keys, order, hot_rows)
    group = F.struct(*[F.col(k) for k in keys])
    ends = ranged.groupBy("_part").agg(
        F.min_by(group, "_at").alias("first"),
        F.max_by(group, "_at").alias("last"),
        F.max_by(F.struct(group.alias("g"), F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.col("_at"))).alias("held"),
    )
    given, before = [], None
    for r in sorted(ends.collect(), key=lambda x: x["_part"]):
        # what the range before ended with, if it ended with the group that this one begins with
        carry = before[1] if before and before[0] == r["first"] else None
        given.append((r["_part"], r["first"], carry))
        if r["held"] is not None and r["held"]["g"] == r["last"]:
            carry = r["held"]["v"]
        elif r["first"] != r["last"]:
            carry = None
        before = (r["last"], carry)
    schema = ranged.select("_part", group.alias("_first"), F.col(value).alias("_carry")).schema
    for f in schema.fields:
        f.nullable = True
    handed = F.broadcast(df.sparkSession.createDataFrame(given, schema))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(*upto))
    joined = ranged.join(handed, "_part", "left").withColumn(out, F.coalesce(own, F.when(group == F.col("_first"), F.col("_carry"))))
    return few.unionByName(joined.select(*few.columns))


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, range_rows: int = 1_000_000) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (bigint, not null) up to each row of its group, whatever the groups' sizes.

    Rows are range-partitioned by group and order; sums run inside each range, and
    the total that a range ends with is handed on: one small row per range goes
    over the driver. ``keys`` may be empty (one group); null keys form groups.
    """
    ranged = _ranges(df, keys, order, range_rows)
    group = F.struct(F.lit(0).alias("_one"), *[F.col(k) for k in keys])
    sums = ranged.groupBy("_part", *keys).agg(F.sum(value).alias("s"), F.min("_at").alias("lo"), F.max("_at").alias("hi")).withColumn("g", group)
    ends = sums.groupBy("_part").agg(F.min_by("g", "lo").alias("first"), F.max_by("g", "hi").alias("last"), F.max_by("s", "hi").alias("tail"))
    given, before = [], None
    for r in sorted(ends.collect(), key=lambda x: x["_part"]):
        carry = before[1] if before and before[0] == r["first"] else 0
        given.append((r["_part"], r["first"], carry))
        before = (r["last"], r["tail"] + (carry if r["first"] == r["last"] else 0))
    schema = ranged.select("_part", group.alias("_first"), F.lit(0).cast("long").alias("_carry")).schema
    for f in schema.fields:
        f.nullable = True
    handed = F.broadcast(df.sparkSession.createDataFrame(given, schema))
    own = F.sum(value).over(Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    total = own + F.when(group.eqNullSafe(F.col("_first")), F.col("_carry")).otherwise(0)
    return ranged.join(handed, "_part").withColumn(out, total).select(*df.columns, out)


def exact_medians(df: DataFrame, keys: list[str], value: str, out: str, range_rows: int = 1_000_000) -> DataFrame:
    """(keys..., out): the exact median of the non-null values of each group, of any size.

    Equal values combine map-side to counts, whose running totals find the middle.
    An even number of values gives the mean of the two middle ones; groups without a value are absent.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, keys, [F.col(value).asc()], "_n", "_upto", range_rows)
    # one row per group: its size is left to the planner
    totals = placed.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.max("_upto").alias("_all"))
    both = placed.join(totals, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) if keys else placed.join(F.broadcast(totals))
    low = F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") + 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1, F.col(value)))
    return both.groupBy(*keys).agg(((low + high) / 2).alias(out))
