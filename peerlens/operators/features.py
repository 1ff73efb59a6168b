"""Features of subjects: activity, flows, cluster shape, origin fusion, morphology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.functions.arrays import paired
from peerlens.functions.stats import distinct_with_null, truncated_median
from peerlens.functions.text import script_type
from peerlens.operators.asof import asof_join
from peerlens.operators.graph import snapshot as ledger_at
from peerlens.operators.ordered import exact_medians
from peerlens.runtime import durable

# The round sums under which amounts are kept by structuring, in satoshis.
LADDER = (100_000, 1_000_000, 10_000_000, 100_000_000)


def tx_sides(tx: DataFrame) -> DataFrame:
    """One row per address of either side, carrying the whole transaction's total.

    This is the legacy grain: the total repeats for every address. The exact
    grain is :func:`flows`.
    """
    def one(column: str, side: str) -> DataFrame:
        return tx.select("txid", "first_seen_us", F.col("total_out_sats").alias("sats"), "fee_rate_sat_vb", "has_equal_outputs", "is_coinbase", F.explode(column).alias("address")).where(F.col("address").isNotNull()).withColumn("side", F.lit(side))

    return one("input_addresses", "in").unionByName(one("output_addresses", "out"))


def windows(sides: DataFrame, members: DataFrame, boundary_us: int) -> DataFrame:
    """(subject_id, window): train if the subject was active before the boundary, else holdout."""
    first = sides.join(members, "address").groupBy("subject_id").agg(F.min("first_seen_us").alias("_first"))
    return first.select("subject_id", F.when(F.col("_first") < boundary_us, "train").otherwise("holdout").alias("window"))


def in_window(sides: DataFrame, members: DataFrame, boundary_us: int) -> DataFrame:
    """Side rows of each subject on its own side of the boundary."""
    w = windows(sides, members, boundary_us)
    rows = sides.join(members, "address").join(w, "subject_id")
    return rows.where((F.col("window") == "train") == (F.col("first_seen_us") < boundary_us))


def activity(rows: DataFrame) -> DataFrame:
    """The activity block of every subject from its side rows, in one grouping."""
    sent, got = F.col("side") == "in", F.col("side") == "out"
    when = lambda c, x: F.when(c, F.col(x))
    return rows.groupBy("subject_id").agg(
        F.count_distinct(when(sent, "txid")).alias("n_tx_sent"), F.count_distinct(when(got, "txid")).alias("n_tx_received"),
        F.sum(when(sent, "sats")).alias("total_sent_sats"), F.sum(when(got, "sats")).alias("total_received_sats"),
        F.avg(when(sent, "sats")).alias("mean_sent_sats"), F.avg(when(got, "sats")).alias("mean_received_sats"),
        F.avg(when(sent, "fee_rate_sat_vb")).alias("mean_fee_rate"), F.avg(F.when(sent, F.col("has_equal_outputs").cast("int"))).alias("frac_equal_outputs"),
        F.sum(F.when(got, F.col("is_coinbase").cast("int"))).alias("n_coinbase_received"),
        (F.sum(when(got, "sats")) - F.sum(when(sent, "sats"))).alias("balance_sats"),
    )


def counterparties(rows: DataFrame) -> DataFrame:
    """(subject_id, n_counterparties): other addresses that share a transaction with a member.

    The subject's own further members count; only the address itself does not. An
    address counts unless the subject met it by that address alone, so counting
    needs no pairs of addresses: per subject and transaction, all addresses count
    if two members took part, else all but the one.
    """
    mine = rows.select("subject_id", "txid", "address").distinct()
    size = mine.groupBy("subject_id", "txid").agg(F.count(F.lit(1)).alias("_own"), F.min("address").alias("_only"))
    met = size.join(rows.select("txid", "address").distinct(), "txid").where((F.col("_own") > 1) | (F.col("address") != F.col("_only")))
    return met.groupBy("subject_id").agg(F.count_distinct("address").alias("n_counterparties"))


def max_fan_out(rows: DataFrame) -> DataFrame:
    """(subject_id, max_fan_out): most own input addresses in one transaction (the legacy meaning)."""
    per_tx = rows.where("side = 'in'").groupBy("subject_id", "txid").agg(F.count_distinct("address").alias("_n"))
    return per_tx.groupBy("subject_id").agg(F.max("_n").alias("max_fan_out"))


def dwell(rows: DataFrame) -> DataFrame:
    """(subject_id, median_dwell_us): median time from a receipt to the address's next send."""
    got = rows.where("side = 'out' and first_seen_us is not null").select("subject_id", "address", "txid", F.col("first_seen_us").alias("got_us"))
    sends = rows.where("side = 'in' and first_seen_us is not null").select("address", F.col("first_seen_us").alias("sent_us"))
    paired = asof_join(got, sends, ["address"], "got_us", "sent_us", [], direction="forward").where(F.col("sent_us").isNotNull())
    return paired.groupBy("subject_id").agg(truncated_median(F.col("sent_us") - F.col("got_us")).alias("median_dwell_us"))


def cluster_shape(claims: DataFrame, members: DataFrame, active: DataFrame) -> DataFrame:
    """Active size, weakest live link and number of heuristics of each subject.

    Both ends of a claim are joined to members, which never builds member pairs.
    """
    live = members.join(active.select("address").distinct(), "address", "left_semi")
    sizes = live.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_addresses"))
    left = live.select("subject_id", F.col("address").alias("src"))
    right = live.select("subject_id", F.col("address").alias("dst"))
    held = claims.select("src", "dst", "confidence", "evidence").join(left, "src").join(right, ["subject_id", "dst"])
    weakest = held.groupBy("subject_id").agg(F.min("confidence").alias("min_edge_confidence"), distinct_with_null(F.col("evidence")).alias("n_heuristics"))
    return sizes.join(weakest, "subject_id", "left")


def script_types(live: DataFrame) -> DataFrame:
    """(subject_id, n_script_types): address formats among a subject's active members; an unknown one counts as one."""
    kind = script_type(F.col("address"))
    return live.groupBy("subject_id").agg((F.count_distinct(kind) + F.max(kind.isNull().cast("int"))).cast("long").alias("n_script_types"))


# The columns of the subject table in contract order.
SUBJECT_FEATURES = (
    "n_addresses", "n_tx_sent", "total_sent_sats", "mean_sent_sats", "n_tx_received", "total_received_sats", "mean_received_sats", "balance_sats", "n_counterparties", "max_fan_out", "n_coinbase_received",
    "frac_equal_outputs", "mean_fee_rate", "median_dwell_us", "min_edge_confidence", "n_heuristics", "n_script_types", "mean_p_origin", "mean_origin_margin", "frac_origin_abstained", "frac_top1_tor",
    "mean_p_asn", "mean_asn_margin", "frac_l1_abstained", "mean_n_announcements", "n_typologies", "n_typology_txns", "fan_in_ratio", "peel_chain_depth", "peel_leak_frac", "structuring_frac", "burstiness", "fee_anomaly",
)
# The columns that tell of origins, operators and patterns, which a snapshot lacks.
FUSED = ("mean_p_origin", "mean_origin_margin", "frac_origin_abstained", "frac_top1_tor", "mean_p_asn", "mean_asn_margin", "frac_l1_abstained", "mean_n_announcements", "n_typologies", "n_typology_txns")
# Columns in which nothing found is zero.
ZERO_FILLED = ("n_typologies", "n_typology_txns", "fan_in_ratio", "peel_chain_depth", "peel_leak_frac", "structuring_frac", "burstiness", "fee_anomaly")


def subject_table(rows: DataFrame, tx: DataFrame, members: DataFrame, claims: DataFrame, boundary_us: int, fused: list[DataFrame]) -> DataFrame:
    """One row per subject of ``rows`` (side rows in their window) with all blocks, and the ``fused`` frames joined in.

    Pattern and shape columns without a finding are zero; all others stay null.
    """
    pairs = rows.where("side = 'in'").select("subject_id", "txid").distinct()
    live = members.join(rows.select("address").distinct(), "address", "left_semi")
    out = activity(rows)
    for block in (counterparties(rows), max_fan_out(rows), dwell(rows), cluster_shape(claims, members, rows.select("address")), script_types(live), morphology(tx, pairs, boundary_us), *fused):
        out = out.join(block, "subject_id", "left")
    return out.fillna(0, subset=[c for c in ZERO_FILLED if c in out.columns])


def snapshot_table(tx: DataFrame, ledger: DataFrame, clusters_of, start_us: int, end_us: int, threshold: float = 0.3) -> DataFrame:
    """(subject_id, 23 features) of the window [start_us, end_us], with the ownership known at its end.

    ``ledger`` holds claims with the instant at which they became available;
    ``clusters_of`` makes (member, root) of edges. Subjects are the groups of the
    edges known at the end and the other addresses seen by then, as far as they are
    active in the window. Flows are exact: summed once per subject and transaction.
    """
    if start_us > end_us:
        raise ValueError("the window ends before it starts")
    window = tx.where(F.col("first_seen_us").between(start_us, end_us))
    edges = durable(ledger_at(ledger, end_us).where(F.col("confidence") >= threshold), "snapshot-edges")
    grouped = clusters_of(edges).select(F.col("member").alias("address"), F.concat(F.lit("group:"), "root").alias("subject_id"))
    seen = tx_sides(tx.where(F.col("first_seen_us") <= end_us)).select("address").distinct()
    single = seen.join(grouped, "address", "left_anti").select("address", F.concat(F.lit("addr:"), "address").alias("subject_id"))
    members = durable(grouped.unionByName(single), "snapshot-members")
    rows = durable(in_window(tx_sides(window), members, end_us + 1), "snapshot-rows")
    # all heuristics and weakest links are those of the edges known at the end
    table = subject_table(rows, window, members, edges, end_us + 1, [])
    exact = flows(window, members)
    table = table.drop(*[c for c in exact.columns if c != "subject_id"]).join(exact, "subject_id", "left").fillna(0, subset=["total_sent_sats", "total_received_sats", "n_counterparties", "balance_sats"])
    return table.select("subject_id", *[c for c in SUBJECT_FEATURES if c not in FUSED])


def origin_fusion(estimates: DataFrame, sent_pairs: DataFrame) -> DataFrame:
    """Five features of the origin estimates of what a subject sent."""
    top = estimates.where("rank = 1").groupBy("txid").agg(F.max("p_origin").alias("p_origin"), F.max("margin").alias("margin"), F.max("n_announcements").alias("n_announcements"), F.bool_or("is_tor_exit").alias("is_tor_exit"))
    joined = sent_pairs.select("subject_id", "txid").distinct().join(top.withColumn("_hit", F.lit(1)), "txid", "left")
    return joined.groupBy("subject_id").agg(
        F.avg("p_origin").alias("mean_p_origin"), F.avg("margin").alias("mean_origin_margin"), F.avg("n_announcements").alias("mean_n_announcements"),
        F.avg(F.col("is_tor_exit").cast("int")).alias("frac_top1_tor"), F.avg(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias("frac_origin_abstained"),
    )


def operator_fusion(rollup: DataFrame, sent_pairs: DataFrame) -> DataFrame:
    """Three features of the operator estimates, refused ones included."""
    joined = sent_pairs.select("subject_id", "txid").distinct().join(rollup.select("txid", "p_asn", "margin", "abstain"), "txid")
    return joined.groupBy("subject_id").agg(F.avg("p_asn").alias("mean_p_asn"), F.avg("margin").alias("mean_asn_margin"), F.avg(F.col("abstain").cast("int")).alias("frac_l1_abstained"))


def typology_load(hits: DataFrame, sent_pairs: DataFrame) -> DataFrame:
    """Typologies and flagged transactions of each subject within its sends."""
    flagged = hits.select("subject_id", "typology", F.explode("txids").alias("txid")).join(sent_pairs.select("subject_id", "txid").distinct(), ["subject_id", "txid"])
    return flagged.groupBy("subject_id").agg(F.count_distinct("typology").alias("n_typologies"), F.count_distinct("txid").alias("n_typology_txns"))


def morphology(tx: DataFrame, sent_pairs: DataFrame, boundary_us: int | None = None) -> DataFrame:
    """Six shape features of what a subject sent.

    The going fee rate is the median of the window that a transaction falls into:
    before the boundary or from it on; without a boundary all form one window.
    Transactions without an instant belong to no window of a boundary.
    """
    window = F.lit(0) if boundary_us is None else F.when(F.col("first_seen_us").isNotNull(), (F.col("first_seen_us") >= boundary_us).cast("int"))
    tx = tx.withColumn("_window", window)
    # one row per window
    median = exact_medians(tx.where(F.col("_window").isNotNull()), ["_window"], "fee_rate_sat_vb", "_median")
    banded = F.exists("output_amounts", lambda x: reduce(lambda a, b: a | b, [(x >= t * 9 // 10) & (x < t) for t in LADDER]))
    shape = tx.select(
        "txid", "_window", "first_seen_us", "n_out", "total_out_sats", "fee_rate_sat_vb", F.size("input_addresses").alias("n_in"), F.array_min("output_amounts").alias("lo"),
        F.array_max("output_amounts").alias("hi"), F.coalesce(banded, F.lit(False)).alias("banded"),
    )
    rows = sent_pairs.select("subject_id", "txid").distinct().join(shape, "txid").join(F.broadcast(median), "_window", "left")
    peel = (F.col("n_in") == 1) & (F.col("n_out") == 2) & (F.col("lo") * 4 < F.col("hi"))
    gap = F.col("first_seen_us") - F.lag("first_seen_us").over(Window.partitionBy("subject_id").orderBy("first_seen_us"))
    rows = rows.withColumn("_gap", F.when(F.col("first_seen_us").isNotNull(), gap))
    burst = F.when((F.count("_gap") < 2) | (F.avg("_gap") == 0), 0.0).otherwise(F.stddev_samp("_gap") / F.avg("_gap"))
    return rows.groupBy("subject_id").agg(
        F.max("n_in").alias("fan_in_ratio"), F.count_if(F.coalesce(peel, F.lit(False))).alias("peel_chain_depth"), F.avg(F.when(peel, F.col("lo") / F.col("total_out_sats"))).alias("peel_leak_frac"),
        F.avg(F.col("banded").cast("int")).alias("structuring_frac"), burst.alias("burstiness"), F.avg(F.col("fee_rate_sat_vb") - F.col("_median")).alias("fee_anomaly"),
    )


def flows(tx: DataFrame, members: DataFrame) -> DataFrame:
    """Exact gross flows of each subject, and the other subjects it met.

    Amounts are summed once per subject and transaction; counterparties are
    subjects, not addresses.
    """
    def side(addresses: str, amounts: str) -> DataFrame:
        return tx.select("txid", F.inline(paired(addresses, amounts))).where(F.col("address").isNotNull())

    ins, outs = side("input_addresses", "input_amounts"), side("output_addresses", "output_amounts")
    sent = ins.join(members, "address").groupBy("subject_id", "txid").agg(F.sum("sats").alias("sats"))
    got = outs.join(members, "address").groupBy("subject_id", "txid").agg(F.sum("sats").alias("sats"))
    s = sent.join(tx.select("txid", "fee_rate_sat_vb", "has_equal_outputs"), "txid").groupBy("subject_id").agg(
        F.sum("sats").alias("total_sent_sats"), F.avg("sats").alias("mean_sent_sats"), F.avg("fee_rate_sat_vb").alias("mean_fee_rate"), F.avg(F.col("has_equal_outputs").cast("int")).alias("frac_equal_outputs"))
    g = got.groupBy("subject_id").agg(F.sum("sats").alias("total_received_sats"), F.avg("sats").alias("mean_received_sats"))
    owner = members.select("address", F.col("subject_id").alias("other"))
    in_subjects = ins.join(owner, "address").select("txid", "other").distinct()
    out_subjects = outs.join(owner, "address").select("txid", "other").distinct()
    met = sent.select("subject_id", "txid").join(out_subjects, "txid").unionByName(got.select("subject_id", "txid").join(in_subjects, "txid")).where(F.col("subject_id") != F.col("other"))
    c = met.groupBy("subject_id").agg(F.count_distinct("other").alias("n_counterparties"))
    out = s.join(g, "subject_id", "full").join(c, "subject_id", "full")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.withColumn("total_sent_sats", zero("total_sent_sats")).withColumn("total_received_sats", zero("total_received_sats")).withColumn("n_counterparties", zero("n_counterparties")).withColumn("balance_sats", F.col("total_received_sats") - F.col("total_sent_sats"))


def pooled(context: DataFrame, links: DataFrame, values: list[str], prefix: str) -> DataFrame:
    """Per subject: log-degree, mean, population deviation, least and largest of its transactions' values."""
    rows = links.select("subject_id", "txid").distinct().join(context.select("txid", *values), "txid")
    aggs = [F.log1p(F.count(F.lit(1))).alias(f"{prefix}_degree")]
    for v in values:
        x = F.coalesce(F.col(v).cast("double"), F.lit(0.0))
        aggs += [F.avg(x).alias(f"{prefix}_{v}_mean"), F.stddev_pop(x).alias(f"{prefix}_{v}_std"), F.min(x).alias(f"{prefix}_{v}_min"), F.max(x).alias(f"{prefix}_{v}_max")]
    return rows.groupBy("subject_id").agg(*aggs)


def relational(tx: DataFrame, members: DataFrame, ann: DataFrame, peers: DataFrame, local: DataFrame, class_codes: dict[str, int]) -> DataFrame:
    """FTR-16: 329 values per subject of ``local``, whose other columns are the subject's own values.

    The context of a transaction is its own six values, the mean of nine values of its
    announcers and the mean of the own values of the subjects that fund it. It is
    pooled through the received and the spent side; a subject without links on a side
    has zeros there. Transactions and announcements need an instant. Values are
    signed logs, before any frozen scaling.
    """
    own = [c for c in local.columns if c != "subject_id"]
    of_tx, n_classes = ["n_in", "n_out", "total_out_sats", "fee_sats", "fee_rate_sat_vb", "has_equal_outputs"], 6
    of_peer = ["observations", "transactions", "observers", *[f"class_{i}" for i in range(n_classes)]]
    timed = tx.where("first_seen_us is not null")
    values = timed.groupBy("txid").agg(*[F.max(F.log1p(F.greatest(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))).alias(c) for c in of_tx])
    seen = ann.where("seen_us is not null").join(values.select("txid"), "txid")
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in class_codes.items() for x in kv]), F.col("net_class")), F.lit(0))
    counts = seen.groupBy("peer_ip").agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("txid").alias("transactions"), F.count_distinct("observer_ip").alias("observers"))
    announcers = counts.join(peers.select("peer_ip", "net_class"), "peer_ip", "left").select(
        "peer_ip", *[F.log1p(F.col(c).cast("double")).alias(c) for c in of_peer[:3]], *[(code == i).cast("double").alias(f"class_{i}") for i in range(n_classes)])
    heard = seen.select("peer_ip", "txid").distinct().join(announcers, "peer_ip").groupBy("txid").agg(*[F.avg(c).alias(f"announcer_mean_{c}") for c in of_peer])
    logs = local.select("subject_id", *[signed_log(F.col(c)).alias(c) for c in own])

    def links(column: str) -> DataFrame:
        return timed.select("txid", F.explode(column).alias("address")).join(members, "address").select("subject_id", "txid").distinct().join(logs.select("subject_id"), "subject_id")

    funds, receives = links("input_addresses"), links("output_addresses")
    funded = funds.join(logs, "subject_id").groupBy("txid").agg(*[F.avg(c).alias(f"funder_mean_{c}") for c in own])
    context = durable(values.join(heard, "txid", "left").join(funded, "txid", "left").fillna(0.0), "context")
    fields = [c for c in context.columns if c != "txid"]
    sides = [pooled(context, receives, fields, "received"), pooled(context, funds, fields, "spent")]
    return logs.join(sides[0], "subject_id", "left").join(sides[1], "subject_id", "left").fillna(0.0)


def signed_log(value):
    """Sign of a value times log1p of its size; null and NaN count as 0."""
    x = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.signum(x) * F.log1p(F.abs(x))
