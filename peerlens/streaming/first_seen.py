"""Streaming forms of the intake: first sight per transaction, windows, late rows.

Event time is the announcement's instant. Rows later than the watermark are
dropped by the engine; a transaction is final once the watermark has passed its
first sight by the decision horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(stream: DataFrame, column: str = "ts_us", late: str = "10 minutes") -> DataFrame:
    """Stream with an ``at`` timestamp and a watermark; rows without an instant are left out."""
    return stream.where(F.col(column).isNotNull()).withColumn("at", F.timestamp_micros(F.col(column))).withWatermark("at", late)


def announcement_windows(stream: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Announcements and peers per tumbling or sliding window and message type."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return stream.groupBy(w.alias("w"), "msg_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("src_ip").alias("peers")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "msg_type", "n", "peers")


def peer_sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a peer: announcements without a longer gap."""
    w = F.session_window("at", gap)
    return stream.groupBy(w.alias("w"), "src_ip").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "src_ip", "n")


def without_repeats(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


def first_sights(stream: DataFrame, horizon_us: int = 5_000_000) -> DataFrame:
    """(txid, first_us, src_ip, n): the first announcer of a transaction, when it is final.

    State per transaction: first instant, its peer (ties by peer) and the number of
    announcements up to the horizon. It is emitted and dropped when the watermark
    has passed the horizon.
    """
    out = "txid string, first_us long, src_ip string, n long"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, peer, times = state.get
            state.remove()
            yield pd.DataFrame([(key[0], first, peer, sum(t <= first + horizon_us for t in times))], columns=["txid", "first_us", "src_ip", "n"])
            return
        first, peer, times = state.get if state.exists else (None, None, [])
        times = list(times)
        for frame in frames:
            for at, ip in zip(frame["ts_us"].tolist(), frame["src_ip"].tolist(), strict=True):
                times.append(at)
                if first is None or (at, ip or "") < (first, peer or ""):
                    first, peer = at, ip
            times = [t for t in times if t <= first + horizon_us]  # what lies beyond can never count
        state.update((first, peer, times))
        state.setTimeoutTimestamp(max((first + horizon_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(columns=["txid", "first_us", "src_ip", "n"])

    return stream.groupBy("txid").applyInPandasWithState(update, out, "first_us long, src_ip string, times array<long>", "append", "EventTimeTimeout")
