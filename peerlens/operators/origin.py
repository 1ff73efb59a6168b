"""Where a transaction entered the network: candidates, estimators, operator roll-up.

Every estimator gives candidates a score, turns it into probabilities that need
not sum to one, and ends in :func:`finalise`, the only place where mass is
capped, ranks and margins are taken and abstention is decided.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.operators.asof import asof_join

# The log-gap of the escape mass, the smallest prior, and the decay of the first-seen rule.
ESCAPE_GAP, EPS = 1.0, 1e-12
FIRST, DECAY = 0.5, 0.5
# Codes of the network classes; any other class is 0. Tor exits go by two names.
CLASS_CODES = {"hosting": 1, "residential": 2, "tor_exit": 3, "tor": 3, "unknown": 4, "vpn_suspect": 5}
# Least separation of the first two candidates, and fewest announcements, to answer.
MARGIN_FLOOR, MIN_ANNOUNCEMENTS = 0.04, 2
# Weak evidence that refuses a transaction at every grain.
INHERITED = ("tor_present", "single_observer", "too_few_announcements")


def payer_links(ann: DataFrame, tx: DataFrame) -> DataFrame:
    """(txid, peer_ip, payer_shared): transactions of the same first payer that the peer announced."""
    payer = tx.select("txid", F.get("input_addresses", F.lit(0)).alias("payer")).where(F.col("payer").isNotNull())
    pairs = ann.select("txid", "peer_ip").distinct().join(payer, "txid")
    shared = pairs.groupBy("payer", "peer_ip").agg(F.count(F.lit(1)).alias("payer_shared"))
    return pairs.join(shared, ["payer", "peer_ip"]).select("txid", "peer_ip", "payer_shared")


def candidates(ann: DataFrame, peers: DataFrame, payers: DataFrame | None = None, degree: DataFrame | None = None) -> DataFrame:
    """One row per (txid, peer_ip) with the evidence about it."""
    n_observers = ann.agg(F.count_distinct("observer_ip").alias("_all"))
    grouped = ann.groupBy("txid", "peer_ip").agg(
        F.min("row_id").alias("row_id"), F.min("seen_us").alias("seen_us"), F.min("delta_first_us").alias("delta_first_us"), F.min("rank_in_tx").alias("rank_in_tx"),
        F.count(F.lit(1)).alias("n_announcements"), F.count_distinct("observer_ip").alias("n_observers_seen"), (F.max("seen_us") - F.min("seen_us")).alias("announce_spread_us"),
    )
    per_tx = ann.groupBy("txid").agg(F.count_distinct("observer_ip").alias("n_observers_in_tx"))
    out = grouped.join(peers.select("peer_ip", F.col("frac_rank_one").alias("peer_frac_rank_one"), F.col("n_txids").alias("peer_n_txids"), "net_class"), "peer_ip", "left").join(per_tx, "txid")
    out = out.join(payers, ["txid", "peer_ip"], "left") if payers is not None else out.withColumn("payer_shared", F.lit(0).cast("long"))
    out = out.join(degree, "peer_ip", "left") if degree is not None else out.withColumn("peer_degree", F.lit(0).cast("long"))
    out = out.join(F.broadcast(n_observers))
    code = reduce(lambda acc, kv: acc.when(F.col("net_class") == kv[0], kv[1]), CLASS_CODES.items(), F.when(F.lit(False), 0)).otherwise(0)
    return out.select(
        "txid", "peer_ip", "row_id", "seen_us", "delta_first_us", "rank_in_tx", "n_announcements", "n_observers_seen", "announce_spread_us", "n_observers_in_tx", "net_class",
        F.coalesce("peer_frac_rank_one", F.lit(0.0)).alias("peer_frac_rank_one"), F.coalesce("peer_n_txids", F.lit(0)).alias("peer_n_txids"),
        F.coalesce("payer_shared", F.lit(0)).alias("payer_shared"), F.coalesce("peer_degree", F.lit(0)).alias("peer_degree"),
        F.count(F.lit(1)).over(Window.partitionBy("txid")).alias("n_candidates"),
        F.greatest(F.col("_all") - F.col("n_observers_seen"), F.lit(0)).alias("n_observers_blind"),
        F.coalesce(F.col("net_class").isin("tor_exit", "tor"), F.lit(False)).alias("is_tor_exit"), F.coalesce(F.col("net_class").isin("hosting", "vpn_suspect"), F.lit(False)).alias("is_hosting"),
        code.cast("int").alias("net_class_code"),
    )


def with_likelihood(cand: DataFrame, arrival: DataFrame | None, relay_us: float) -> DataFrame:
    """Candidates with ``mle_logscore``: prior times observers, less lead and mean dispersion.

    Without an arrival matrix the delay alone counts; a candidate missing from it
    takes its transaction's lowest score.
    """
    mean = max(relay_us, 1.0)
    if arrival is None:
        return cand.withColumn("mle_logscore", -F.col("delta_first_us") / mean)
    per_peer = arrival.groupBy("txid", "peer_ip").agg(F.count_distinct("observer_id").alias("_m"), F.min("seen_us").alias("_first"), F.sum("seen_us").cast("decimal(38,0)").alias("_sum"))
    per_tx = arrival.groupBy("txid").agg(F.min("seen_us").alias("_tx_first"))
    dispersion = (F.col("_sum") - F.col("_m") * F.col("_first")).cast("double") / F.col("_m")
    joined = cand.join(per_peer, ["txid", "peer_ip"], "left").join(per_tx, "txid", "left")
    score = F.col("_m") * F.log(F.col("peer_frac_rank_one") + EPS) - (F.col("_first") - F.col("_tx_first")) / mean - dispersion / mean
    scored = joined.withColumn("_s", score).drop("_m", "_first", "_sum", "_tx_first")
    w = Window.partitionBy("txid")
    return scored.withColumn("mle_logscore", F.coalesce("_s", F.min("_s").over(w), F.lit(0.0))).drop("_s")


def escape_softmax(df: DataFrame, score: str, out: str = "p_origin") -> DataFrame:
    """Softmax within a transaction against a phantom held one log below the leader."""
    w = Window.partitionBy("txid")
    lifted = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return lifted.withColumn(out, F.col("_e") / (F.sum("_e").over(w) + math.exp(-ESCAPE_GAP))).drop("_e")


def finalise(scored: DataFrame, estimator: str, margin_floor: float = MARGIN_FLOOR, min_announcements: int = MIN_ANNOUNCEMENTS) -> DataFrame:
    """Cap, rank, margin and abstention of every transaction.

    Mass above one is scaled down to one, mass below stays. Order is probability,
    then row_id. An abstaining transaction has no rank 1: its ranks start at 2.
    """
    tx = Window.partitionBy("txid")
    full = tx.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = tx.orderBy(F.desc("p_origin"), F.asc("row_id"))
    capped = scored.withColumn("p_origin", F.col("p_origin") / F.greatest(F.sum("p_origin").over(tx), F.lit(1.0)))
    placed = capped.withColumn("_at", F.row_number().over(ordered))
    lead = F.max(F.when(F.col("_at") == 1, F.col("p_origin"))).over(full)
    second = F.coalesce(F.max(F.when(F.col("_at") == 2, F.col("p_origin"))).over(full), F.lit(0.0))
    placed = placed.withColumn("_p1", lead).withColumn("_p2", second).withColumn("_tor", F.bool_or("is_tor_exit").over(tx)).withColumn("_n", F.sum("n_announcements").over(tx))
    separation = F.when(F.col("_p1") + F.col("_p2") > 0, (F.col("_p1") - F.col("_p2")) / (F.col("_p1") + F.col("_p2"))).otherwise(0.0)
    reason = (
        F.when(F.col("_tor"), "tor_present")
        .when(F.col("n_observers_in_tx") <= 1, "single_observer")
        .when(F.col("_n") < min_announcements, "too_few_announcements")
        .when(separation < margin_floor, "margin_below_floor")
    )
    out = placed.withColumn("margin", F.col("_p1") - F.col("_p2")).withColumn("abstain_reason", reason)
    out = out.withColumn("abstain", F.col("abstain_reason").isNotNull())
    return out.withColumn("rank", (F.col("_at") + F.col("abstain").cast("int")).cast("int")).withColumn("estimator", F.lit(estimator)).drop("_at", "_p1", "_p2", "_tor", "_n")


def first_spy(cand: DataFrame, **rules: float) -> DataFrame:
    """The first announcer, with mass halving down the order of arrival."""
    order = Window.partitionBy("txid").orderBy("delta_first_us", "row_id")
    return finalise(cand.withColumn("p_origin", FIRST * F.pow(F.lit(DECAY), F.row_number().over(order) - 1)), "first_spy", **rules)


def timing_mle(cand: DataFrame, **rules: float) -> DataFrame:
    """Maximum likelihood over all observers; needs ``mle_logscore``."""
    return finalise(escape_softmax(cand, "mle_logscore"), "timing_mle", **rules)


def fallback_ensemble(cand: DataFrame, **rules: float) -> DataFrame:
    """The ensemble's order where it has no labels: payer linkage, then arrival."""
    order = Window.partitionBy("txid").orderBy(F.desc("payer_shared"), "delta_first_us", "row_id")
    return finalise(cand.withColumn("p_origin", FIRST * F.pow(F.lit(DECAY), F.row_number().over(order) - 1)), "ensemble", **rules)


def _leaders(df: DataFrame, key: str, score: str) -> DataFrame:
    """Leader row and runner-up score per transaction, ties by key, as two aggregates."""
    order = Window.partitionBy("txid").orderBy(F.desc(score), F.col(key).asc_nulls_first())
    placed = df.withColumn("_at", F.row_number().over(order)).where("_at <= 2")
    cols = [c for c in df.columns if c != "txid"]
    top = placed.groupBy("txid").agg(*[F.max(F.when(F.col("_at") == 1, F.col(c))).alias(c) for c in cols], F.coalesce(F.max(F.when(F.col("_at") == 2, F.col(score))), F.lit(0.0)).alias("_second"))
    return top


def operator_rollup(estimates: DataFrame, peers: DataFrame, asn_prior: DataFrame, margin_floor: float = MARGIN_FLOOR) -> DataFrame:
    """One operator and one country per transaction, with refusal.

    Mass is summed by operator and weighted by its prior; a null operator is a
    group of its own with no prior.
    """
    flags = estimates.groupBy("txid").agg(F.min("abstain_reason").alias("_reason"), F.max("p_origin").alias("_lead"))
    short = estimates.join(flags.select("txid", "_lead"), "txid").where(F.col("p_origin") >= F.col("_lead") * math.exp(-ESCAPE_GAP)).groupBy("txid").agg(F.count(F.lit(1)).alias("shortlist_size"))
    labelled = estimates.select("txid", "peer_ip", "p_origin").join(peers.select("peer_ip", "asn", "as_org", "net_class", "geo_country"), "peer_ip", "left")
    by_asn = labelled.groupBy("txid", "asn").agg(F.sum("p_origin").alias("_mass"), F.min("as_org").alias("as_org"), F.min("net_class").alias("net_class"))
    by_asn = by_asn.join(asn_prior.where(F.col("asn").isNotNull()).select("asn", F.col("frac_rank_one").alias("_prior")), "asn", "left")
    by_asn = escape_softmax(by_asn.withColumn("_score", F.col("_mass") * (F.coalesce("_prior", F.lit(0.0)) + EPS)), "_score", "p_asn")
    top = _leaders(by_asn.select("txid", F.col("asn").alias("origin_asn"), "as_org", "net_class", "p_asn"), "origin_asn", "p_asn")
    by_country = escape_softmax(labelled.groupBy("txid", "geo_country").agg(F.sum("p_origin").alias("_score")), "_score", "p_country")
    country = _leaders(by_country.select("txid", F.col("geo_country").alias("origin_country"), "p_country"), "origin_country", "p_country").drop("_second")
    joined = top.join(country, "txid").join(short, "txid", "left").join(flags, "txid")
    separation = F.when(F.col("p_asn") + F.col("_second") > 0, (F.col("p_asn") - F.col("_second")) / (F.col("p_asn") + F.col("_second"))).otherwise(0.0)
    reason = F.when(F.col("_reason").isin(*INHERITED), F.col("_reason")).when(separation < margin_floor, "cross_asn_ambiguous")
    out = joined.withColumn("margin", F.col("p_asn") - F.col("_second")).withColumn("abstain_reason", reason)
    return out.select("txid", "origin_asn", "as_org", "net_class", "p_asn", "origin_country", "p_country", "margin", F.coalesce("shortlist_size", F.lit(0)).alias("shortlist_size"), F.col("abstain_reason").isNotNull().alias("abstain"), "abstain_reason")


def causal_candidates(ann: DataFrame, peers: DataFrame, tx: DataFrame, horizon_us: int = 5_000_000) -> DataFrame:
    """Candidates from evidence within the horizon and histories strictly before the first sight.

    Running counts per peer, operator and payer are taken over time and read by
    strict as-of joins, so nothing at or after a transaction's first sight counts.
    """
    first = ann.groupBy("txid").agg(F.min("seen_us").alias("first_seen_us"))
    window = ann.select("row_id", "txid", "peer_ip", "observer_ip", "seen_us").join(first, "txid").where(F.col("seen_us") <= F.col("first_seen_us") + horizon_us)
    window = window.withColumn("rank_in_tx", F.rank().over(Window.partitionBy("txid").orderBy("seen_us")))
    grouped = window.groupBy("txid", "peer_ip").agg(
        F.min("row_id").alias("row_id"), F.min("seen_us").alias("seen_us"), F.min("first_seen_us").alias("first_seen_us"), F.min("rank_in_tx").alias("rank_in_tx"),
        F.count(F.lit(1)).alias("n_announcements"), F.count_distinct("observer_ip").alias("n_observers_seen"),
    )
    payer = tx.select("txid", F.get("input_addresses", F.lit(0)).alias("payer"))
    query = grouped.join(peers.select("peer_ip", "asn", "net_class"), "peer_ip", "left").join(payer, "txid", "left")

    def running(rows: DataFrame, keys: list[str], at: str, value: Column, name: str) -> DataFrame:
        """(keys, at, name): sum of a value over all rows up to a time, one row per time."""
        steps = rows.groupBy(*keys, "seen_us").agg(F.sum(value).alias("_v"))
        w = Window.partitionBy(*keys).orderBy("seen_us").rowsBetween(Window.unboundedPreceding, 0)
        return steps.select(*keys, F.col("seen_us").alias(at), F.sum("_v").over(w).alias(name))

    one = F.lit(1)
    hist = running(window, ["peer_ip"], "_t1", one, "peer_seen").join(running(window, ["peer_ip"], "_t1", (F.col("rank_in_tx") == 1).cast("int"), "peer_firsts"), ["peer_ip", "_t1"])
    query = asof_join(query, hist, ["peer_ip"], "first_seen_us", "_t1", ["peer_seen", "peer_firsts"], strict=True)
    query = asof_join(query, running(grouped, ["peer_ip"], "_t2", one, "peer_n_txids"), ["peer_ip"], "first_seen_us", "_t2", ["peer_n_txids"], strict=True)
    paid = grouped.join(payer, "txid").where(F.col("payer").isNotNull())
    query = asof_join(query, running(paid, ["payer", "peer_ip"], "_t3", one, "payer_shared"), ["payer", "peer_ip"], "first_seen_us", "_t3", ["payer_shared"], strict=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return query.select(
        "txid", "peer_ip", "row_id", "seen_us", "first_seen_us", "rank_in_tx", "n_announcements", "n_observers_seen", "net_class",
        F.coalesce(F.col("peer_firsts") / F.col("peer_seen"), F.lit(0.0)).alias("peer_frac_rank_one"), zero("peer_n_txids"), zero("payer_shared"),
        F.greatest("_t1", "_t2", "_t3").alias("max_history_us"),
    )
