"""Connected components by alternating large and small stars.

Every round links each vertex to the smallest neighbour it knows (large star for
the larger neighbours, small star for the smaller ones) until nothing changes;
the number of rounds grows with the logarithm of the graph. Members stand for
64-bit numbers meanwhile, the rows of hubs are split, and lineage is cut by a
durable table per round. A graph of few edges is solved in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.runtime import discard, durable, hot_keys, skew_join

# Up to so many edges are solved in one task.
ONE_TASK_EDGES = 50_000


def _star(edges: DataFrame, large: bool, hot_rows: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # the smallest neighbour is combined map-side; the neighbours themselves are never collected
    smallest = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = skew_join(near, smallest, "u", hot_keys(near, "u", least=hot_rows))
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(smallest.where("u <> m").select("u", F.col("m").alias("v")))


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of a graph held in memory and the smallest vertex of each one's component, by pointer doubling."""
    ids, ends = np.unique(np.r_[u, v], return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def _in_one_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [(f["u"].to_numpy(), f["v"].to_numpy()) for f in frames]
    if held:
        ids, roots = roots_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pd.DataFrame({"v": ids, "r": roots})


def _labels(edges: DataFrame, hot_rows: int, one_task_edges: int) -> DataFrame:
    """(v, r) of every vertex of bigint edges (u, v)."""
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    if now.count() <= one_task_edges:
        return durable(now.coalesce(1).mapInPandas(_in_one_task, "v long, r long"), "labels")
    sign = None
    while True:
        half = durable(_star(now, True, hot_rows), "star")
        after = durable(_star(half, False, hot_rows).where("u <> v").distinct(), "star")
        # the edge set has converged when its order-free fingerprint and size repeat
        key = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        discard(now, half)
        now = after
        if key == sign:
            break
        sign = key
    return now.select(F.col("u").alias("v"), F.col("v").alias("r")).unionByName(now.select("v", F.col("v").alias("r")).distinct())


def components(edges: DataFrame, src: str = "src", dst: str = "dst", hot_rows: int = 100_000, one_task_edges: int = ONE_TASK_EDGES, numbered: bool = False) -> DataFrame:
    """(member, root) of every end of an edge; root is the component's smallest member.

    Null ends and edges from a member to itself tie nothing; an empty table gives
    an empty result. Members stand for their 64-bit hashes; where two share one
    (or ``numbered`` asks for it) they are numbered instead, so the result is exact.
    """
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(src).alias("a"), F.col(dst).alias("b"))
    written = durable(pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct().select("member", F.monotonically_increasing_id().alias("i"), F.xxhash64("member").alias("v")), "members")
    total = written.count()
    if numbered or written.select("v").distinct().count() < total:
        names, pairs = written.select("member", F.col("i").alias("v")), pairs.distinct()
        ends = skew_join(pairs, names.select(F.col("member").alias("a"), F.col("v").alias("u")), "a", hot_keys(pairs, "a", least=hot_rows)).select("u", "b")
        ends = skew_join(ends, names.select(F.col("member").alias("b"), "v"), "b", hot_keys(pairs, "b", least=hot_rows)).select("u", "v")
    else:
        names, ends = written.select("member", "v"), pairs.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))
    named = durable(names.join(_labels(ends, hot_rows, one_task_edges), "v").select("member", "r"), "named")
    smallest = named.groupBy("r").agg(F.min("member").alias("root"))
    return skew_join(named, smallest, "r", hot_keys(named, "r", least=hot_rows) if total > hot_rows else None).select("member", "root")
