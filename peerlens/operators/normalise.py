"""From announcements as received to announcement, peer, operator, transaction and address tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.functions.arrays import contains, has_repeats, paired, total
from peerlens.functions.stats import first_by, truncated_median
from peerlens.functions.text import script_type
from peerlens.operators.asof import asof_join

# Amounts that are a multiple of this are payments of a round sum, never change.
ROUND_SATS = 1_000


def announcements(sealed: DataFrame) -> DataFrame:
    """One row per announcement with its rank and delay within its transaction.

    Rows without an instant or a txid are left out; equal instants share a rank.
    """
    base = sealed.where(F.col("ts_us").isNotNull() & F.col("txid").isNotNull()).select(
        "row_id", "txid", F.col("src_ip").alias("peer_ip"), F.col("src_port").alias("peer_port"), F.col("dst_ip").alias("observer_ip"),
        F.col("dst_port").alias("observer_port"), F.col("ts_us").alias("seen_us"), "observer_id", "geo_country", "asn", "msg_type",
    )
    tx = Window.partitionBy("txid")
    return base.withColumn("rank_in_tx", F.rank().over(tx.orderBy("seen_us"))).withColumn("delta_first_us", F.col("seen_us") - F.min("seen_us").over(tx))


def peer_facts(shortlists: DataFrame) -> DataFrame:
    """(peer_ip, v_asn, v_as_org, v_net_class): vendor facts, one row per peer."""
    return (
        shortlists.where(F.col("peer_ip").isNotNull())
        .groupBy("peer_ip")
        .agg(F.min("asn").alias("v_asn"), F.min("as_org").alias("v_as_org"), F.min("net_class").alias("v_net_class"), F.min("geo_country").alias("v_geo_country"))
    )


def peers(ann: DataFrame, facts: DataFrame) -> DataFrame:
    """Per peer: activity, mean rank, share of first ranks, and where it sits.

    A value of the capture (first non-null in row order) beats the vendor's.
    """
    own = ann.groupBy("peer_ip").agg(
        F.count(F.lit(1)).alias("n_announcements"),
        F.count_distinct("txid").alias("n_txids"),
        F.avg("rank_in_tx").alias("mean_rank"),
        F.avg((F.col("rank_in_tx") == 1).cast("int")).alias("frac_rank_one"),
        F.count_distinct("peer_port").alias("distinct_ports"),
        first_by(F.col("geo_country"), F.col("row_id")).alias("geo_country"),
        first_by(F.col("asn"), F.col("row_id")).alias("asn"),
        F.min("seen_us").alias("first_us"),
        F.max("seen_us").alias("last_us"),
    )
    joined = own.join(facts, "peer_ip", "left")
    return joined.select(
        "peer_ip", "n_announcements", "n_txids", "mean_rank", "frac_rank_one", "distinct_ports",
        F.coalesce("geo_country", "v_geo_country").alias("geo_country"), F.coalesce("asn", "v_asn").alias("asn"),
        F.col("v_as_org").alias("as_org"), F.col("v_net_class").alias("net_class"), "first_us", "last_us",
    )


def enriched(ann: DataFrame, peer_table: DataFrame) -> DataFrame:
    """Announcements with their peer's facts; the announcement's own values win."""
    p = peer_table.select("peer_ip", F.col("geo_country").alias("_geo"), F.col("asn").alias("_asn"), "as_org", "net_class", F.col("n_txids").alias("peer_seen_count"))
    out = ann.join(p, "peer_ip", "left")
    return out.withColumn("geo_country", F.coalesce("geo_country", "_geo")).withColumn("asn", F.coalesce("asn", "_asn")).drop("_geo", "_asn")


# The network classes of a peer.
NET_CLASSES = ("hosting", "mobile", "residential", "tor", "unknown", "vpn_suspect")


def asn_rollup(peer_table: DataFrame, enriched_ann: DataFrame) -> DataFrame:
    """Per operator: peers by class and announcement-weighted first ranks.

    Peers without an operator form one row with a null asn, matched null-safely.
    """
    by_peer = peer_table.groupBy("asn").agg(
        F.min("as_org").alias("as_org"),
        F.min("geo_country").alias("geo_country"),
        F.count(F.lit(1)).alias("n_peers"),
        *[F.count_if(F.col("net_class").isin(c, f"{c}_exit")).alias(f"n_{c}") for c in NET_CLASSES],
    )
    by_ann = enriched_ann.groupBy(F.col("asn").alias("_asn")).agg(
        F.count(F.lit(1)).alias("n_announcements"), F.count_distinct("txid").alias("n_txids"), F.avg((F.col("rank_in_tx") == 1).cast("int")).alias("frac_rank_one")
    )
    return by_peer.join(by_ann, F.col("asn").eqNullSafe(F.col("_asn")), "left").drop("_asn")


def arrival(ann: DataFrame) -> DataFrame:
    """The arrival matrix in long form."""
    return ann.select("txid", "observer_id", "peer_ip", "seen_us")


def transactions(sealed: DataFrame) -> DataFrame:
    """One row per txid with the chain facts of its first row.

    ``input_amounts`` and ``output_amounts`` must be whole satoshis (bigint
    arrays); a null array gives null totals. The fee is inputs less outputs, 0
    for a coinbase; a missing or zero vsize gives no fee rate.
    """
    chain = F.struct("input_addresses", "output_addresses", "input_amounts", "output_amounts", "vsize", "block_height")
    grouped = sealed.where(F.col("txid").isNotNull()).groupBy("txid").agg(
        F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"), F.count(F.lit(1)).alias("n_announcements"),
        F.count_distinct("src_ip").alias("n_distinct_peers"), F.min_by(chain, "row_id").alias("c"),
    )
    t = grouped.select("*", "c.*").drop("c")
    t = t.withColumns({
        "announce_spread_us": F.col("last_seen_us") - F.col("first_seen_us"),
        "n_in": F.size("input_addresses"),
        "n_out": F.size("output_addresses"),
        "is_coinbase": F.size("input_addresses") == 0,
        "has_equal_outputs": has_repeats(F.col("output_amounts")),
        "total_in_sats": total(F.col("input_amounts")),
        "total_out_sats": total(F.col("output_amounts")),
    })
    t = t.withColumn("fee_sats", F.when(F.col("is_coinbase"), F.lit(0).cast("long")).otherwise(F.col("total_in_sats") - F.col("total_out_sats")))
    t = t.withColumn("fee_rate_sat_vb", F.when(F.col("vsize") > 0, F.col("fee_sats") / F.col("vsize")))
    return t.withColumn("change_index", change_index())


def change_index():
    """0-based index of the one output that is not round and pays no own input, else -1."""
    own = F.col("input_addresses")
    slots = F.transform(F.arrays_zip(F.col("output_amounts").alias("amount"), F.col("output_addresses").alias("address")), lambda x, i: F.struct(i.alias("i"), x["amount"].alias("amount"), x["address"].alias("address")))
    candidates = F.filter(slots, lambda x: (x["amount"] % ROUND_SATS != 0) & ~contains(own, x["address"]))
    return F.when((F.size(candidates) == 1) & (F.size("output_addresses") >= 2), F.get(candidates, F.lit(0))["i"]).otherwise(-1).cast("int")


def sides(tx: DataFrame) -> DataFrame:
    """(address, txid, side, sats, at_us): every input and output of every transaction."""
    def one(addresses: str, amounts: str, side: str) -> DataFrame:
        return tx.select("txid", F.col("first_seen_us").alias("at_us"), F.inline(paired(addresses, amounts))).where(F.col("address").isNotNull()).select("address", "txid", F.lit(side).alias("side"), "sats", "at_us")

    return one("input_addresses", "input_amounts", "in").unionByName(one("output_addresses", "output_amounts", "out"))


def dwell_times(side_rows: DataFrame) -> DataFrame:
    """(address, dwell_time_us): median time from the latest receipt to each spend."""
    spends = side_rows.where("side = 'in' and at_us is not null").select("address", "txid", F.col("at_us").alias("spent_us"))
    receipts = side_rows.where("side = 'out' and at_us is not null").select("address", F.col("at_us").alias("received_us"))
    paired = asof_join(spends, receipts, ["address"], "spent_us", "received_us", [])
    return paired.where(F.col("received_us").isNotNull()).groupBy("address").agg(truncated_median(F.col("spent_us") - F.col("received_us")).alias("dwell_time_us"))


def addresses(tx: DataFrame) -> DataFrame:
    """Per address: activity on both sides, balance, dwell and output type."""
    rows = sides(tx)
    both = rows.groupBy("address").agg(
        F.min("at_us").alias("first_seen_us"), F.max("at_us").alias("last_seen_us"),
        F.count_distinct(F.when(F.col("side") == "out", F.col("txid"))).alias("n_tx_in"),
        F.count_distinct(F.when(F.col("side") == "in", F.col("txid"))).alias("n_tx_out"),
        F.coalesce(F.sum(F.when(F.col("side") == "out", F.col("sats"))), F.lit(0)).alias("total_received_sats"),
        F.coalesce(F.sum(F.when(F.col("side") == "in", F.col("sats"))), F.lit(0)).alias("total_sent_sats"),
    )
    out = both.withColumn("balance_sats", F.col("total_received_sats") - F.col("total_sent_sats")).join(dwell_times(rows), "address", "left")
    return out.withColumn("script_type", script_type(F.col("address")))


def declared_script_types(sealed: DataFrame) -> DataFrame:
    """(address, script_type): the type first declared for an address, where lists match."""
    fit = sealed.where(F.size("script_types") == F.size("output_addresses"))
    pairs = fit.select("row_id", F.inline(F.arrays_zip(F.col("output_addresses").alias("address"), F.col("script_types").alias("kind"))))
    return pairs.where(F.col("address").isNotNull()).groupBy("address").agg(first_by(F.col("kind"), F.col("row_id")).alias("script_type"))
