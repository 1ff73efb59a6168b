"""Synthetic announcements: weighted choice, peer graphs and flooding, one seed per transaction."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seed_of(*parts: object) -> int:
    """A seed that depends on the parts only."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "little")


def weighted_sample(weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k positions without replacement, by the k smallest exponential keys over the weights."""
    keys = rng.exponential(size=len(weights)) / np.where(weights > 0, weights, np.nan)
    order = np.argsort(np.where(np.isnan(keys), np.inf, keys), kind="stable")
    return order[: min(k, int((weights > 0).sum()))]


def peer_graph(n: int, links: int, seed: int) -> list[np.ndarray]:
    """Neighbours of each of n peers; each opens ``links`` connections, preferring well-connected ones."""
    rng = np.random.default_rng(seed)
    near: list[set[int]] = [set() for _ in range(n)]
    degree = np.ones(n)
    for i in range(1, n):
        for j in weighted_sample(degree[:i], links, rng):
            near[i].add(int(j))
            near[int(j)].add(i)
            degree[i] += 1
            degree[j] += 1
    return [np.array(sorted(s), np.int64) for s in near]


def flood(near: list[np.ndarray], source: int, mean_us: float, rng: np.random.Generator) -> np.ndarray:
    """First arrival in microseconds at every peer, hops being independent exponential delays."""
    at = np.full(len(near), np.inf)
    at[source] = 0.0
    queue = [(0.0, source)]
    while queue:
        t, i = heapq.heappop(queue)
        if t > at[i]:
            continue
        delays = rng.exponential(mean_us, size=len(near[i]))
        for j, d in zip(near[i], delays, strict=True):
            if t + d < at[j]:
                at[j] = t + d
                heapq.heappush(queue, (t + d, int(j)))
    return at


def topology(peers: int, observers: int, links: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Neighbours of each peer, and the peers that each observer is linked to."""
    near = peer_graph(peers, links, seed)
    rng = np.random.default_rng(seed + 1)
    degree = np.array([len(x) for x in near], float)
    return near, [np.sort(weighted_sample(degree, max(1, peers // 4), rng)) for _ in range(observers)]


HEARD = ["txid", "true_peer", "observer_id", "peer_ip", "seen_us"]


def heard(near: list[np.ndarray], watched: list[np.ndarray], txid: str, source: int, begin: int, mean_us: float, rng: np.random.Generator) -> list[tuple]:
    """What the observers hear of one transaction: each linked peer at its arrival plus one hop."""
    at = flood(near, source, mean_us, rng)
    return [(txid, f"p{source}", f"obs-{o + 1:02d}", f"p{p}", begin + int(at[p] + rng.exponential(mean_us))) for o, linked in enumerate(watched) for p in linked if np.isfinite(at[p])]


def announcements(spark: SparkSession, transactions: int, peers: int = 100, observers: int = 5, links: int = 4, mean_us: float = 2_000_000.0, seed: int = 42, start_us: int = 1_735_689_600_000_000) -> DataFrame:
    """(txid, true_peer, observer_id, peer_ip, seen_us): what observers hear of flooded transactions.

    Transactions are independent given their own seeds, so they are simulated in
    parallel and come out the same on any cluster.
    """
    shared = spark.sparkContext.broadcast(topology(peers, observers, links, seed))

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, watched = shared.value
        for frame in frames:
            rows = []
            for i in frame["id"].tolist():
                own = np.random.default_rng(seed_of(seed, i))
                source, begin = int(own.integers(len(near))), start_us + i * 600_000_000 + int(own.integers(600_000_000))
                rows += heard(near, watched, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), source, begin, mean_us, own)
            yield pd.DataFrame(rows, columns=HEARD)

    return spark.range(transactions).mapInPandas(simulate, "txid string, true_peer string, observer_id string, peer_ip string, seen_us long")


def flooded(origins: DataFrame, peers: int = 60, observers: int = 4, links: int = 4, mean_us: float = 2_000_000.0, seed: int = 42) -> DataFrame:
    """As :func:`announcements`, for given transactions (txid, true_ip, broadcast_us); an address always sits at one peer."""
    shared = origins.sparkSession.sparkContext.broadcast(topology(peers, observers, links, seed))

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, watched = shared.value
        for frame in frames:
            rows = []
            for txid, ip, begin in zip(frame["txid"], frame["true_ip"], frame["broadcast_us"], strict=True):
                rows += heard(near, watched, txid, seed_of(ip) % len(near), int(begin), mean_us, np.random.default_rng(seed_of(seed, txid)))
            yield pd.DataFrame(rows, columns=HEARD)

    return origins.select("txid", "true_ip", "broadcast_us").mapInPandas(simulate, "txid string, true_peer string, observer_id string, peer_ip string, seen_us long")


def as_sealed(ann: DataFrame) -> DataFrame:
    """Generated announcements in the columns that the normalisation reads."""
    return ann.select(
        F.xxhash64("txid", "observer_id", "peer_ip").alias("row_id"), "txid", F.col("peer_ip").alias("src_ip"), F.lit(8333).alias("src_port"), F.col("observer_id").alias("dst_ip"), F.lit(8333).alias("dst_port"),
        F.col("seen_us").alias("ts_us"), "observer_id", F.lit(None).cast("string").alias("geo_country"), F.lit(None).cast("int").alias("asn"), F.lit("inv").alias("msg_type"),
    )
