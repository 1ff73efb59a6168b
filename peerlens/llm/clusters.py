"""Pairwise matches to groups, by low-diameter decomposition (problem 1).

Every vertex draws an exponential shift; clusters grow from the vertices with the
largest shifts, one hop a round, and a vertex joins the cluster that reaches it
first. Clusters contract to super-vertices, the edges between clusters form the
next, geometrically smaller graph, and the assignments of all levels compose to
one label per vertex. Whatever the shifts are, a vertex only ever joins a cluster
of its own component, so the result is exact; they only decide how fast it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.runtime import discard, durable, hot_keys, repeated, salted, skew_join

# Rate of the shifts: larger means smaller clusters and more levels, fewer rounds.
BETA = 0.2
# Growth rounds of a level. Clusters that would grow further go on in the next level.
ROUNDS = 6
# From a level of at most so many edges on, all levels run in one task: the same steps, without exchanges.
ONE_TASK_EDGES = 50_000


def _shift(vertex: Column, level: int, beta: float) -> Column:
    """Exponential variate of a vertex, a pure function of vertex and level."""
    unit = (F.shiftrightunsigned(F.xxhash64(vertex, F.lit(level)), 11).cast("double") + 1.0) / F.lit(2.0**53 + 1)
    return (-F.log(unit) / beta).cast("float")


def _arcs(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, as (v, to)."""
    pair = lambda a, b: F.struct(F.col(a).alias("v"), F.col(b).alias("to"))
    return edges.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("_a")).select("_a.v", "_a.to")


def _grow(edges: DataFrame, level: int, beta: float, rounds: int, hot: DataFrame | None) -> DataFrame:
    """(v, center) of every vertex of ``edges`` (u, v); ``hot`` marks the vertices with very many edges."""
    both = _arcs(edges).withColumn("cost", F.lit(1).cast("float"))
    vertices = both.select("v").distinct()
    # an arc to itself keeps what a vertex has, so each round reads the state once and the plan stays linear
    arcs = both.unionByName(vertices.select("v", F.col("v").alias("to"), F.lit(0).cast("float").alias("cost")))
    arcs = arcs if hot is None else salted(arcs, ["v"], hot)
    state = vertices.select("v", _shift(F.col("v"), level, beta).alias("lead"), F.col("v").alias("center"), F.lit(True).alias("moved"))
    for _ in range(rounds):
        met = arcs.join(state, "v") if hot is None else arcs.join(repeated(state, ["v"], hot), ["v", "_salt"])
        # only a vertex that changed has something new to offer; offers to one vertex combine map-side
        offers = met.where(F.col("moved") | (F.col("cost") == 0)).select(F.col("to").alias("v"), (F.col("lead") - F.col("cost")).alias("lead"), "center", "cost")
        best = offers.groupBy("v").agg(F.max_by("center", "lead").alias("center"), F.max("lead").alias("lead"), F.max(F.when(F.col("cost") == 0, F.col("lead"))).alias("had"))
        state = best.select("v", "lead", "center", (F.col("lead") > F.col("had")).alias("moved"))
    return state.select("v", "center")


def decompose_arrays(u: np.ndarray, v: np.ndarray, beta: float = BETA, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and their roots, by the same levels as :func:`decompose`, of a graph held in memory."""
    ids, ends = np.unique(np.r_[u, v], return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(ids))
    level, size = 0, len(ids)
    while len(a):
        lead, center = np.random.default_rng(level).exponential(1 / beta, size), np.arange(size)
        for _ in range(rounds):
            best, chosen = lead.copy(), center.copy()
            for x, y in ((a, b), (b, a)):
                np.maximum.at(best, y, lead[x] - 1)
            for x, y in ((a, b), (b, a)):
                won = (lead[x] - 1 == best[y]) & (best[y] > lead[y])
                chosen[y[won]] = center[x[won]]
            if not (best > lead).any():
                break
            lead, center = best, chosen
        kept, center = np.unique(center, return_inverse=True)
        level, size, label = level + 1, len(kept), center[label]
        cut = center[a] != center[b]
        low, high = np.minimum(center[a], center[b])[cut], np.maximum(center[a], center[b])[cut]
        pairs = np.unique(low * np.int64(size) + high)
        a, b = pairs // size, pairs % size
    smallest = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    return ids, smallest[label]


def _in_one_task(frames: Iterator[pd.DataFrame], beta: float, rounds: int) -> Iterator[pd.DataFrame]:
    held = [(f["u"].to_numpy(), f["v"].to_numpy()) for f in frames]
    if held:
        ids, roots = decompose_arrays(*(np.concatenate(x) for x in zip(*held, strict=True)), beta, rounds)
        yield pd.DataFrame({"v": ids, "root": roots})


def decompose(edges: DataFrame, beta: float = BETA, rounds: int = ROUNDS, hot_rows: int = 100_000, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(v, root) for the vertices of an undirected graph of bigint edges (u, v)."""
    current = durable(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges-0")
    assigned: list[tuple[DataFrame, int]] = []
    level = 0
    while (n := current.count()) > one_task_edges:
        hot = hot_keys(_arcs(current), "v", least=hot_rows) if 2 * n > hot_rows else None
        step = durable(_grow(current, level, beta, rounds, hot), f"assign-{level}")
        assigned.append((step, 2 * n))
        ends = skew_join(current.withColumnRenamed("v", "w"), step.select("v", F.col("center").alias("cu")).withColumnRenamed("v", "u"), "u", hot).select(F.col("w").alias("v"), "cu")
        ends = skew_join(ends, step.select("v", F.col("center").alias("cv")), "v", hot).where("cu <> cv")
        level += 1
        following = durable(ends.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct(), f"edges-{level}")
        discard(current)
        current = following
    # the last levels are the smallest; composing backwards joins each level once
    total = durable(current.coalesce(1).mapInPandas(lambda frames: _in_one_task(frames, beta, rounds), "v long, root long"), "assign")
    discard(current)
    for step, most in reversed(assigned):
        hot = hot_keys(step, "center", least=hot_rows) if most > hot_rows else None
        # a cluster without edges to others has no vertex in the next level and keeps its center
        joined = skew_join(step, total.select(F.col("v").alias("center"), "root"), "center", hot, "left")
        lower, total = total, durable(joined.select("v", F.coalesce("root", "center").alias("root")), "compose")
        discard(step, lower)
    return total


def groups(pairs: DataFrame, a: str = "a", b: str = "b", id_col: str = "address", label: str = "cluster_id", hot_rows: int = 100_000, one_task_edges: int = ONE_TASK_EDGES, numbered: bool = False) -> DataFrame:
    """(id, label) of every record tied to another one; label is the group's smallest id.

    Pairs may come in either order and repeat; pairs with a null end and pairs of
    a record with itself tie nothing. Ids are compared by code point. An empty
    table gives an empty result; other columns are ignored. Ids stand for their
    64-bit hashes while clusters grow; where two ids share one (or ``numbered``
    asks for it) they are numbered instead, so the result is exact.
    """
    claims = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    names = claims.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    # the numbers are written once, so they never change
    written = durable(names.select("name", F.monotonically_increasing_id().alias("i"), F.xxhash64("name").alias("v")), "names")
    total = written.count()
    if numbered or written.select("v").distinct().count() < total:
        names = written.select("name", F.col("i").alias("v"))
        claims = claims.distinct()
        hot_a, hot_b = hot_keys(claims, "a", least=hot_rows), hot_keys(claims, "b", least=hot_rows)
        edges = skew_join(claims, names.select(F.col("name").alias("a"), F.col("v").alias("u")), "a", hot_a).select("u", "b")
        edges = skew_join(edges, names.select(F.col("name").alias("b"), "v"), "b", hot_b).select("u", "v")
    else:
        names = written.select("name", "v")
        edges = claims.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))
    roots = decompose(edges, hot_rows=hot_rows, one_task_edges=one_task_edges)
    named = durable(names.join(roots, "v").select("root", F.col("name").alias(id_col)), "named")
    discard(written, roots)
    smallest = named.groupBy("root").agg(F.min(id_col).alias(label))
    hot = hot_keys(named, "root", least=hot_rows) if total > hot_rows else None
    return skew_join(named, smallest, "root", hot).select(id_col, label)
