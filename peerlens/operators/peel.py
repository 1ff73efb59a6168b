"""Peel chains: transactions that shave a small payment off and pass the rest on.

A hop has at most one successor and one predecessor, so the hops form paths and
cycles. Roots and positions come from pointer doubling, which takes the logarithm
of the longest chain in joins instead of a walk along it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions.arrays import arg_max, total
from peerlens.operators.graph import mixer
from peerlens.runtime import discard, durable

# A payment of at most 7/20 of the whole is a peel; kept as integers, so no rounding.
PAY_NUM, PAY_DEN = 7, 20
MIN_DEPTH = 2


def hops(tx: DataFrame) -> DataFrame:
    """Transactions of peel shape with what they paid, kept and came from.

    Two unequal outputs, the smaller at most 7/20 of both, no coinbase and no
    mixer; null amounts are no hop. The change is the larger output.
    """
    amounts = F.col("output_amounts")
    whole, pay = total(amounts), F.array_min(amounts)
    shape = ~F.col("is_coinbase") & (F.size("output_addresses") == 2) & (F.size(amounts) == 2) & ~mixer() & F.forall(amounts, lambda x: x.isNotNull())
    shape = shape & (F.array_min(amounts) < F.array_max(amounts)) & (whole > 0) & (pay > 0) & (pay * PAY_DEN <= whole * PAY_NUM)
    return tx.where(shape).select(
        "txid", "first_seen_us", F.col("total_in_sats").alias("in_sats"), pay.alias("peeled_sats"),
        F.get(F.col("output_addresses"), arg_max(amounts)).alias("change_address"), F.get(F.col("input_addresses"), arg_max(F.col("input_amounts"))).alias("root_address"),
    )


def links(tx: DataFrame, hop_rows: DataFrame) -> DataFrame:
    """Each hop with its successor, or the reason why there is none.

    No spender of the change: no_continuation; several: ambiguous_spend; a
    spender that is no hop or the hop itself, or two hops with one successor:
    chain_broken.
    """
    change = hop_rows.select(F.col("change_address").alias("address")).where(F.col("address").isNotNull()).distinct()
    spenders = tx.select("txid", F.explode(F.array_distinct("input_addresses")).alias("address")).join(change, "address", "left_semi")
    spender = spenders.groupBy("address").agg(F.count_distinct("txid").alias("n"), F.min("txid").alias("next"))
    step = hop_rows.join(spender.withColumnRenamed("address", "change_address"), "change_address", "left")
    step = step.join(hop_rows.select(F.col("txid").alias("next"), F.lit(True).alias("is_hop")), "next", "left")
    reason = (
        F.when(F.col("n").isNull(), "no_continuation")
        .when(F.col("n") > 1, "ambiguous_spend")
        .when(F.col("is_hop").isNull() | (F.col("next") == F.col("txid")), "chain_broken")
    )
    step = step.withColumn("stop_reason", reason).withColumn("next", F.when(reason.isNull(), F.col("next")))
    crowded = step.where(F.col("next").isNotNull()).groupBy("next").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    step = step.join(crowded, "next", "left")
    clash = F.col("_k").isNotNull()
    return step.select("txid", F.when(~clash, F.col("next")).alias("next"), F.when(clash, "chain_broken").otherwise(F.col("stop_reason")).alias("stop_reason"), "first_seen_us", "in_sats", "peeled_sats", "root_address")


def positions(linked: DataFrame) -> DataFrame:
    """(txid, root, pos): each hop's chain and 0-based place in it.

    A cycle is cut before its smallest txid.
    """
    back = linked.where(F.col("next").isNotNull()).select(F.col("next").alias("txid"), F.col("txid").alias("ptr"))
    state = linked.select("txid").join(back, "txid", "left").select("txid", F.coalesce("ptr", "txid").alias("ptr"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.least("txid", "ptr").alias("low"))
    state = durable(state.withColumn("low", F.coalesce("low", "txid")), "peel")
    n = max(2, state.count())
    reach = 1
    while reach < 2 * n:
        up = state.select(F.col("txid").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("pos").alias("pos2"), F.col("low").alias("low2"))
        after = state.join(up, "ptr").select("txid", F.col("ptr2").alias("ptr"), (F.col("pos") + F.col("pos2")).alias("pos"), F.least("low", "low2").alias("low"))
        after = durable(after, "peel")
        moved = state.select("txid", "ptr").exceptAll(after.select("txid", "ptr")).limit(1).count()
        discard(state)
        state = after
        reach *= 2
        if not moved:
            return state.select("txid", F.col("ptr").alias("root"), "pos")
    # what still moves is on a cycle: restart those hops with the link into the smallest txid cut
    starts = linked.where(F.col("next").isNotNull()).select(F.col("next").alias("_start")).distinct()
    ended = state.join(starts, state["ptr"] == starts["_start"], "left_anti")
    cyclic = state.join(starts, state["ptr"] == starts["_start"], "left_semi").select("txid", "low")
    relinked = linked.join(cyclic, "txid").withColumn("next", F.when(F.col("next") != F.col("low"), F.col("next"))).drop("low")
    return ended.select("txid", F.col("ptr").alias("root"), "pos").unionByName(positions(relinked))


def chains(tx: DataFrame, min_depth: int = MIN_DEPTH) -> DataFrame:
    """One row per chain of at least ``min_depth`` hops.

    Chains are known by their first transaction; ``leak_frac`` is what they
    peeled over what entered, and may exceed 1.
    """
    linked = durable(links(tx, hops(tx)), "peel-links")
    at = positions(linked)
    rows = linked.join(at, "txid")
    one = rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("depth"), F.min_by("in_sats", "pos").alias("initial_sats"), F.sum("peeled_sats").alias("peeled_sats"), F.min_by("root_address", "pos").alias("root_address"),
        F.min("first_seen_us").alias("first_us"), F.max("first_seen_us").alias("last_us"), F.coalesce(F.max_by("stop_reason", "pos"), F.lit("cycle")).alias("stop_reason"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "txid"))), lambda x: x["txid"]).alias("transactions"),
    )
    return one.where(F.col("depth") >= min_depth).withColumn("leak_frac", F.when(F.col("initial_sats") > 0, F.col("peeled_sats") / F.col("initial_sats")))
