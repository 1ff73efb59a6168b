"""Queries of the origin estimators and subject features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions import text
from peerlens.operators import features, origin, typology
from peerlens.operators.components import components
from peerlens.plans import base, network
from peerlens.runtime import durable

RELAY_US = 2_000_000.0
BOUNDARY_US = 1_750_000_000_000_000


def _round(df: DataFrame, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint", "tinyint")})


def candidates(spark: SparkSession, root: str) -> DataFrame:
    a = base.ann(spark, root)
    c = origin.candidates(a, base.peers(spark, root), origin.payer_links(a, base.tx(spark, root)))
    return origin.with_likelihood(c, a, RELAY_US)


def org02_payer_links(spark: SparkSession, root: str) -> DataFrame:
    return origin.payer_links(base.ann(spark, root), base.tx(spark, root))


def org03_candidates(spark: SparkSession, root: str) -> DataFrame:
    return _long(_round(candidates(spark, root).drop("mle_logscore")))


def org04_likelihood(spark: SparkSession, root: str) -> DataFrame:
    return _round(candidates(spark, root).select("txid", "peer_ip", "mle_logscore"), 4)


def _estimates(df: DataFrame) -> DataFrame:
    return _long(_round(df.select("txid", "peer_ip", "p_origin", "rank", "margin", "estimator", "abstain", "abstain_reason")))


def org06_timing_mle(spark: SparkSession, root: str) -> DataFrame:
    return _estimates(origin.timing_mle(candidates(spark, root)))


def org07_first_spy(spark: SparkSession, root: str) -> DataFrame:
    return _estimates(origin.first_spy(candidates(spark, root)))


def org09_fallback_ensemble(spark: SparkSession, root: str) -> DataFrame:
    return _estimates(origin.fallback_ensemble(candidates(spark, root)))


def rollup(spark: SparkSession, root: str, estimates: DataFrame | None = None) -> DataFrame:
    """The operator of each transaction; the estimates are read on several sides, so they are written once."""
    estimates = durable(origin.first_spy(candidates(spark, root)), "estimates") if estimates is None else estimates
    return origin.operator_rollup(estimates, durable(base.peers(spark, root), "peers"), base.asn_rollup(spark, root))


def org10_operator_rollup(spark: SparkSession, root: str) -> DataFrame:
    return _long(_round(rollup(spark, root)))


def org11_causal_candidates(spark: SparkSession, root: str) -> DataFrame:
    return _long(_round(origin.causal_candidates(base.ann(spark, root), base.peers(spark, root), base.tx(spark, root))))


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return features.in_window(features.tx_sides(base.tx(spark, root)), network.subjects(spark, root), BOUNDARY_US)


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    return _rows(spark, root).where("side = 'in'").select("subject_id", "txid").distinct()


def ftr01_sides(spark: SparkSession, root: str) -> DataFrame:
    return _round(features.tx_sides(base.tx(spark, root)))


def ftr02_windows(spark: SparkSession, root: str) -> DataFrame:
    return features.windows(features.tx_sides(base.tx(spark, root)), network.subjects(spark, root), BOUNDARY_US)


def ftr03_activity(spark: SparkSession, root: str) -> DataFrame:
    return _round(features.activity(_rows(spark, root)), 4)


def ftr04_counterparties(spark: SparkSession, root: str) -> DataFrame:
    return features.counterparties(_rows(spark, root))


def ftr05_max_fan_out(spark: SparkSession, root: str) -> DataFrame:
    return features.max_fan_out(_rows(spark, root))


def ftr06_dwell(spark: SparkSession, root: str) -> DataFrame:
    return features.dwell(_rows(spark, root))


def ftr07_cluster_shape(spark: SparkSession, root: str) -> DataFrame:
    return features.cluster_shape(base.claims(spark, root), network.subjects(spark, root), _rows(spark, root).select("address"))


def ftr09_origin_fusion(spark: SparkSession, root: str) -> DataFrame:
    est = origin.first_spy(candidates(spark, root))
    return _round(features.origin_fusion(est, _pairs(spark, root)))


def ftr10_operator_fusion(spark: SparkSession, root: str) -> DataFrame:
    return _round(features.operator_fusion(rollup(spark, root), _pairs(spark, root)))


def ftr11_typology_load(spark: SparkSession, root: str) -> DataFrame:
    hits = typology.hits(typology.sent(base.tx(spark, root), network.subjects(spark, root)))
    return features.typology_load(hits, _pairs(spark, root))


def ftr12_morphology(spark: SparkSession, root: str) -> DataFrame:
    return _long(_round(features.morphology(base.tx(spark, root), _pairs(spark, root), BOUNDARY_US)))


def ftr13_subject_table(spark: SparkSession, root: str) -> DataFrame:
    """The assembled table of every subject: its window and 33 features in contract order."""
    tx, members = durable(base.tx(spark, root), "tx"), durable(network.subjects(spark, root), "subjects")
    rows = durable(features.in_window(features.tx_sides(tx), members, BOUNDARY_US), "subject-rows")
    pairs = rows.where("side = 'in'").select("subject_id", "txid").distinct()
    estimates = durable(origin.first_spy(candidates(spark, root)), "estimates")
    hits = typology.hits(typology.sent(tx, members))
    fused = [features.origin_fusion(estimates, pairs), features.operator_fusion(rollup(spark, root, estimates), pairs), features.typology_load(hits, pairs)]
    out = features.subject_table(rows, tx, members, base.claims(spark, root), BOUNDARY_US, fused)
    window = rows.groupBy("subject_id").agg((F.min("first_seen_us") < BOUNDARY_US).alias("is_train"))
    return _long(_round(out.join(window, "subject_id").select("subject_id", "is_train", *features.SUBJECT_FEATURES), 4))


# The window of the snapshot query.
SNAPSHOT = (1_740_000_000_000_000, 1_755_000_000_000_000)


def ftr15_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The 23 features of a window with the ownership known at its end."""
    ledger = base.claims(spark, root).select("src", "dst", "txid", F.col("ts_us").alias("available_us"), "confidence", "evidence")
    return _long(_round(features.snapshot_table(base.tx(spark, root), ledger, lambda e: components(e), *SNAPSHOT), 4))


def ftr15_flows(spark: SparkSession, root: str) -> DataFrame:
    return _round(features.flows(base.tx(spark, root), network.subjects(spark, root)), 4)


def ftr16_pooled(spark: SparkSession, root: str) -> DataFrame:
    tx = base.tx(spark, root)
    return _round(features.pooled(tx, _pairs(spark, root), ["n_out", "fee_rate_sat_vb"], "spent"), 5)


def ftr16_relational(spark: SparkSession, root: str) -> DataFrame:
    """The whole of FTR-16 for every active subject, over all instants; ``ftr16_pooled`` is the part that its twin fixes."""
    tx, members, a = base.tx(spark, root).where("first_seen_us is not null"), network.subjects(spark, root), base.ann(spark, root)
    rows = durable(features.tx_sides(tx).join(members, "address"), "subject-rows")
    pairs, active = rows.where("side = 'in'").select("subject_id", "txid").distinct(), rows.select("address")
    kind = text.script_type(F.col("address"))
    kinds = rows.groupBy("subject_id").agg((F.count_distinct(kind) + F.max(kind.isNull().cast("int"))).alias("n_script_types"))
    local = features.activity(rows).select("subject_id", "n_tx_sent", "n_tx_received", "n_coinbase_received")
    for block in (features.flows(tx, members), features.max_fan_out(rows), features.dwell(rows), features.cluster_shape(base.claims(spark, root), members, active), kinds, features.morphology(tx, pairs)):
        local = local.join(block, "subject_id", "left")
    local = durable(local, "subject-values")
    return _round(features.relational(tx, members, a, base.peers(spark, root), local, origin.CLASS_CODES), 5)


def ftr17_signed_log(spark: SparkSession, root: str) -> DataFrame:
    f = features.flows(base.tx(spark, root), network.subjects(spark, root))
    return _round(f.select("subject_id", features.signed_log(F.col("balance_sats")).alias("balance_log"), features.signed_log(F.col("mean_sent_sats")).alias("mean_sent_log")))


QUERIES = {f.__name__: f for f in (
    org02_payer_links, org03_candidates, org04_likelihood, org06_timing_mle, org07_first_spy, org09_fallback_ensemble, org10_operator_rollup, org11_causal_candidates,
    ftr01_sides, ftr02_windows, ftr03_activity, ftr04_counterparties, ftr05_max_fan_out, ftr06_dwell, ftr07_cluster_shape, ftr09_origin_fusion, ftr10_operator_fusion, ftr11_typology_load,
    ftr12_morphology, ftr13_subject_table, ftr15_flows, ftr15_snapshot, ftr16_pooled, ftr16_relational, ftr17_signed_log,
)}

PAYER = """payer AS (SELECT txid, input_addresses[1] AS payer FROM tx WHERE input_addresses[1] IS NOT NULL),
  paypairs AS (SELECT DISTINCT a.txid, a.peer_ip, p.payer FROM ann a JOIN payer p USING (txid)),
  links AS (SELECT txid, peer_ip, payer_shared FROM paypairs JOIN (SELECT payer, peer_ip, count(*) AS payer_shared FROM paypairs GROUP BY payer, peer_ip) USING (payer, peer_ip))"""
CAND = f"""{base.ASN}, {base.TX}, {PAYER}, cand AS (
  SELECT g.*, n_observers_in_tx, net_class, coalesce(frac_rank_one, 0) AS peer_frac_rank_one, coalesce(n_txids, 0) AS peer_n_txids, coalesce(payer_shared, 0) AS payer_shared, 0::BIGINT AS peer_degree,
         count(*) OVER (PARTITION BY g.txid) AS n_candidates, greatest((SELECT count(DISTINCT observer_ip) FROM ann) - n_observers_seen, 0) AS n_observers_blind,
         coalesce(net_class = 'tor', false) AS is_tor_exit, coalesce(net_class IN ('hosting', 'vpn_suspect'), false) AS is_hosting,
         CASE net_class WHEN 'hosting' THEN 1 WHEN 'residential' THEN 2 WHEN 'tor' THEN 3 WHEN 'unknown' THEN 4 WHEN 'vpn_suspect' THEN 5 ELSE 0 END AS net_class_code
  FROM (SELECT txid, peer_ip, min(row_id) AS row_id, min(seen_us) AS seen_us, min(delta_first_us) AS delta_first_us, min(rank_in_tx) AS rank_in_tx, count(*) AS n_announcements,
               count(DISTINCT observer_ip) AS n_observers_seen, max(seen_us) - min(seen_us) AS announce_spread_us FROM ann GROUP BY txid, peer_ip) g
  LEFT JOIN peers p USING (peer_ip) JOIN (SELECT txid, count(DISTINCT observer_ip) AS n_observers_in_tx FROM ann GROUP BY txid) USING (txid) LEFT JOIN links l ON l.txid = g.txid AND l.peer_ip = g.peer_ip)"""
MLE = f"""{CAND}, arr AS (SELECT txid, peer_ip, count(DISTINCT observer_id) AS m, min(seen_us) AS f, sum(seen_us) AS s FROM ann GROUP BY txid, peer_ip),
  mle AS (SELECT c.*, m * ln(peer_frac_rank_one + 1e-12) - (f - min(f) OVER (PARTITION BY txid)) / {RELAY_US} - ((s - m::HUGEINT * f)::DOUBLE / m) / {RELAY_US} AS mle_logscore FROM cand c JOIN arr USING (txid, peer_ip))"""


def finalised(score_sql: str, estimator: str) -> str:
    """SQL of the shared ending over a CTE ``s`` with p0."""
    return f"""s AS ({score_sql}),
  cap AS (SELECT *, p0 / greatest(sum(p0) OVER (PARTITION BY txid), 1.0) AS p FROM s),
  pos AS (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY p DESC, row_id) AS plc FROM cap),
  two AS (SELECT *, max(p) FILTER (plc = 1) OVER (PARTITION BY txid) AS p1, coalesce(max(p) FILTER (plc = 2) OVER (PARTITION BY txid), 0) AS p2, bool_or(is_tor_exit) OVER (PARTITION BY txid) AS tor, sum(n_announcements) OVER (PARTITION BY txid) AS n FROM pos),
  why AS (SELECT *, CASE WHEN tor THEN 'tor_present' WHEN n_observers_in_tx <= 1 THEN 'single_observer' WHEN n < 2 THEN 'too_few_announcements' WHEN CASE WHEN p1 + p2 > 0 THEN (p1 - p2) / (p1 + p2) ELSE 0 END < 0.04 THEN 'margin_below_floor' END AS abstain_reason FROM two),
  est AS (SELECT txid, peer_ip, p AS p_origin, plc + (abstain_reason IS NOT NULL)::INT AS rank, p1 - p2 AS margin, '{estimator}' AS estimator, abstain_reason IS NOT NULL AS abstain, abstain_reason, n_announcements, is_tor_exit FROM why)"""


FIRST = finalised("SELECT *, 0.5 * pow(0.5, row_number() OVER (PARTITION BY txid ORDER BY delta_first_us, row_id) - 1) AS p0 FROM cand", "first_spy")
ENS = finalised("SELECT *, 0.5 * pow(0.5, row_number() OVER (PARTITION BY txid ORDER BY payer_shared DESC, delta_first_us, row_id) - 1) AS p0 FROM cand", "ensemble")
TIMING = finalised("SELECT *, e / (sum(e) OVER (PARTITION BY txid) + exp(-1.0)) AS p0 FROM (SELECT *, exp(mle_logscore - max(mle_logscore) OVER (PARTITION BY txid)) AS e FROM mle)", "timing_mle")
_EST = "SELECT txid, peer_ip, round(p_origin, 6) + 0.0 AS p_origin, rank, round(margin, 6) + 0.0 AS margin, estimator, abstain, abstain_reason FROM est"
ROLLUP = f"""{CAND}, {FIRST}, lab AS (SELECT e.txid, e.peer_ip, e.p_origin, p.asn, p.as_org, p.net_class, p.geo_country FROM est e LEFT JOIN peers p USING (peer_ip)),
  flags AS (SELECT txid, min(abstain_reason) AS reason, max(p_origin) AS lead FROM est GROUP BY txid),
  short AS (SELECT txid, count(*) AS shortlist_size FROM est JOIN flags USING (txid) WHERE p_origin >= lead * exp(-1.0) GROUP BY txid),
  ba AS (SELECT l.txid, l.asn, sum(p_origin) * (coalesce(any_value(r.frac_rank_one), 0) + 1e-12) AS sc, min(l.as_org) AS as_org, min(l.net_class) AS net_class FROM lab l LEFT JOIN asn_rollup r ON r.asn = l.asn GROUP BY l.txid, l.asn),
  bp AS (SELECT *, e / (sum(e) OVER (PARTITION BY txid) + exp(-1.0)) AS p FROM (SELECT *, exp(sc - max(sc) OVER (PARTITION BY txid)) AS e FROM ba)),
  bt AS (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY p DESC, asn NULLS FIRST) AS plc FROM bp),
  ta AS (SELECT txid, max(asn) FILTER (plc = 1) AS origin_asn, max(as_org) FILTER (plc = 1) AS as_org, max(net_class) FILTER (plc = 1) AS net_class, max(p) FILTER (plc = 1) AS p_asn, coalesce(max(p) FILTER (plc = 2), 0) AS p2 FROM bt GROUP BY txid),
  ca AS (SELECT txid, geo_country, sum(p_origin) AS sc FROM lab GROUP BY txid, geo_country),
  cp AS (SELECT *, e / (sum(e) OVER (PARTITION BY txid) + exp(-1.0)) AS p FROM (SELECT *, exp(sc - max(sc) OVER (PARTITION BY txid)) AS e FROM ca)),
  ct AS (SELECT txid, geo_country AS origin_country, p AS p_country FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY p DESC, geo_country NULLS FIRST) AS plc FROM cp) WHERE plc = 1),
  rolled AS (SELECT txid, origin_asn, as_org, net_class, p_asn, origin_country, p_country, p_asn - p2 AS margin, coalesce(shortlist_size, 0) AS shortlist_size,
    CASE WHEN reason IN ('tor_present', 'single_observer', 'too_few_announcements') THEN reason WHEN CASE WHEN p_asn + p2 > 0 THEN (p_asn - p2) / (p_asn + p2) ELSE 0 END < 0.04 THEN 'cross_asn_ambiguous' END AS abstain_reason
    FROM ta JOIN ct USING (txid) LEFT JOIN short USING (txid) JOIN flags USING (txid))"""
FSIDES = """fsides AS (SELECT txid, first_seen_us, total_out_sats AS sats, fee_rate_sat_vb, has_equal_outputs, is_coinbase, address, side FROM (
    SELECT *, unnest(input_addresses) AS address, 'in' AS side FROM tx UNION ALL SELECT *, unnest(output_addresses), 'out' FROM tx) WHERE address IS NOT NULL)"""
WIN = f"""{base.SIDES}, {network.SUBJECTS}, {FSIDES},
  win AS (SELECT subject_id, CASE WHEN min(first_seen_us) < {BOUNDARY_US} THEN 'train' ELSE 'holdout' END AS w FROM fsides JOIN subject_map USING (address) GROUP BY subject_id),
  rows_ AS (SELECT * FROM fsides JOIN subject_map USING (address) JOIN win USING (subject_id) WHERE (w = 'train') = (first_seen_us < {BOUNDARY_US})),
  pairs AS (SELECT DISTINCT subject_id, txid FROM rows_ WHERE side = 'in')"""
FLOWS = """own AS (SELECT address, subject_id FROM subject_map),
  i AS (SELECT txid, address, sats FROM sides WHERE side = 'in'), o AS (SELECT txid, address, sats FROM sides WHERE side = 'out'),
  sent AS (SELECT subject_id, txid, sum(sats) AS sats FROM i JOIN own USING (address) GROUP BY ALL), got AS (SELECT subject_id, txid, sum(sats) AS sats FROM o JOIN own USING (address) GROUP BY ALL),
  fs AS (SELECT subject_id, sum(sats)::BIGINT AS total_sent_sats, avg(sats) AS mean_sent_sats, avg(fee_rate_sat_vb) AS mean_fee_rate, avg(has_equal_outputs::INT) AS frac_equal_outputs FROM sent JOIN tx USING (txid) GROUP BY subject_id),
  fg AS (SELECT subject_id, sum(sats)::BIGINT AS total_received_sats, avg(sats) AS mean_received_sats FROM got GROUP BY subject_id),
  met AS (SELECT s.subject_id, w.subject_id AS other FROM sent s JOIN o USING (txid) JOIN own w ON w.address = o.address UNION SELECT s.subject_id, w.subject_id FROM got s JOIN i USING (txid) JOIN own w ON w.address = i.address),
  fc AS (SELECT subject_id, count(DISTINCT other) AS n_counterparties FROM met WHERE subject_id <> other GROUP BY subject_id),
  flows AS (SELECT subject_id, coalesce(total_sent_sats, 0) AS total_sent_sats, mean_sent_sats, mean_fee_rate, frac_equal_outputs, coalesce(total_received_sats, 0) AS total_received_sats, mean_received_sats, coalesce(n_counterparties, 0) AS n_counterparties,
    coalesce(total_received_sats, 0) - coalesce(total_sent_sats, 0) AS balance_sats FROM fs FULL JOIN fg USING (subject_id) FULL JOIN fc USING (subject_id))"""

_SENTROWS = f"""medians AS (SELECT first_seen_us >= {BOUNDARY_US} AS late, median(fee_rate_sat_vb) AS going FROM tx WHERE first_seen_us IS NOT NULL GROUP BY ALL),
  sentx AS (SELECT DISTINCT p.subject_id, t.*, m.going FROM pairs p JOIN tx t USING (txid) LEFT JOIN medians m ON m.late = (t.first_seen_us >= {BOUNDARY_US}))"""
_LADDER = " OR ".join(f"(x >= {t * 9 // 10} AND x < {t})" for t in features.LADDER)
MORPH = f"""{_SENTROWS}, gaps AS (SELECT subject_id, first_seen_us - lag(first_seen_us) OVER (PARTITION BY subject_id ORDER BY first_seen_us) AS gap FROM sentx WHERE first_seen_us IS NOT NULL),
  burst AS (SELECT subject_id, CASE WHEN count(gap) < 2 OR avg(gap) = 0 THEN 0.0 ELSE stddev_samp(gap) / avg(gap) END AS burstiness FROM gaps GROUP BY subject_id),
  morph AS (SELECT s.subject_id, max(len(input_addresses)) AS fan_in_ratio,
    count(*) FILTER (len(input_addresses) = 1 AND n_out = 2 AND list_min(output_amounts) * 4 < list_max(output_amounts)) AS peel_chain_depth,
    avg(list_min(output_amounts)::DOUBLE / total_out_sats) FILTER (len(input_addresses) = 1 AND n_out = 2 AND list_min(output_amounts) * 4 < list_max(output_amounts)) AS peel_leak_frac,
    avg(CASE WHEN len(list_filter(output_amounts, lambda x: {_LADDER})) > 0 THEN 1 ELSE 0 END) AS structuring_frac, coalesce(any_value(burstiness), 0.0) AS burstiness,
    avg(fee_rate_sat_vb - going) AS fee_anomaly FROM sentx s LEFT JOIN burst b ON b.subject_id = s.subject_id GROUP BY s.subject_id)"""

ORACLES = {
    "org02_payer_links": f"WITH {base.ANN}, {base.TX}, {PAYER} SELECT * FROM links",
    "org03_candidates": f"WITH {CAND} SELECT * REPLACE (round(peer_frac_rank_one, 6) + 0.0 AS peer_frac_rank_one) FROM cand",
    "org04_likelihood": f"WITH {MLE} SELECT txid, peer_ip, round(mle_logscore, 4) + 0.0 AS mle_logscore FROM mle",
    "org06_timing_mle": f"WITH {MLE}, {TIMING} {_EST}",
    "org07_first_spy": f"WITH {CAND}, {FIRST} {_EST}",
    "org09_fallback_ensemble": f"WITH {CAND}, {ENS} {_EST}",
    "org10_operator_rollup": f"""WITH {ROLLUP} SELECT txid, origin_asn, as_org, net_class, round(p_asn, 6) + 0.0 AS p_asn, origin_country, round(p_country, 6) + 0.0 AS p_country, round(margin, 6) + 0.0 AS margin, shortlist_size,
      abstain_reason IS NOT NULL AS abstain, abstain_reason FROM rolled""",
    "org11_causal_candidates": f"""WITH {base.PEERS}, {base.TX}, first AS (SELECT txid, min(seen_us) AS first_seen_us FROM ann GROUP BY txid),
      w AS (SELECT a.row_id, a.txid, a.peer_ip, a.observer_ip, a.seen_us, first_seen_us, rank() OVER (PARTITION BY a.txid ORDER BY a.seen_us) AS r FROM ann a JOIN first USING (txid) WHERE a.seen_us <= first_seen_us + 5000000),
      g AS (SELECT txid, peer_ip, min(row_id) AS row_id, min(seen_us) AS seen_us, min(first_seen_us) AS first_seen_us, min(r) AS rank_in_tx, count(*) AS n_announcements, count(DISTINCT observer_ip) AS n_observers_seen FROM w GROUP BY txid, peer_ip),
      q AS (SELECT g.*, p.net_class, input_addresses[1] AS payer FROM g LEFT JOIN peers p USING (peer_ip) LEFT JOIN tx USING (txid)),
      h1 AS (SELECT q.txid, q.peer_ip, count(*) AS n, count(*) FILTER (w.r = 1) AS f, max(w.seen_us) AS t FROM q JOIN w ON w.peer_ip = q.peer_ip AND w.seen_us < q.first_seen_us GROUP BY ALL),
      h2 AS (SELECT q.txid, q.peer_ip, count(*) AS n, max(g.seen_us) AS t FROM q JOIN g ON g.peer_ip = q.peer_ip AND g.seen_us < q.first_seen_us GROUP BY ALL),
      h3 AS (SELECT q.txid, q.peer_ip, count(*) AS n, max(z.seen_us) AS t FROM q JOIN q z ON z.payer = q.payer AND z.peer_ip = q.peer_ip AND z.seen_us < q.first_seen_us GROUP BY ALL)
      SELECT q.txid, q.peer_ip, row_id, seen_us, first_seen_us, rank_in_tx, n_announcements, n_observers_seen, net_class, round(coalesce(h1.f / h1.n, 0), 6) + 0.0 AS peer_frac_rank_one,
        coalesce(h2.n, 0) AS peer_n_txids, coalesce(h3.n, 0) AS payer_shared, greatest(h1.t, h2.t, h3.t) AS max_history_us
      FROM q LEFT JOIN h1 ON h1.txid = q.txid AND h1.peer_ip = q.peer_ip LEFT JOIN h2 ON h2.txid = q.txid AND h2.peer_ip = q.peer_ip LEFT JOIN h3 ON h3.txid = q.txid AND h3.peer_ip = q.peer_ip""",
    "ftr01_sides": f"WITH {base.TX}, {FSIDES} SELECT * REPLACE (round(fee_rate_sat_vb, 6) + 0.0 AS fee_rate_sat_vb) FROM fsides",
    "ftr02_windows": f"WITH {WIN} SELECT subject_id, w AS window FROM win",
    "ftr03_activity": f"""WITH {WIN} SELECT subject_id, count(DISTINCT txid) FILTER (side = 'in') AS n_tx_sent, count(DISTINCT txid) FILTER (side = 'out') AS n_tx_received, (sum(sats) FILTER (side = 'in'))::BIGINT AS total_sent_sats,
      (sum(sats) FILTER (side = 'out'))::BIGINT AS total_received_sats, round(avg(sats) FILTER (side = 'in'), 4) + 0.0 AS mean_sent_sats, round(avg(sats) FILTER (side = 'out'), 4) + 0.0 AS mean_received_sats, round(avg(fee_rate_sat_vb) FILTER (side = 'in'), 4) + 0.0 AS mean_fee_rate,
      round(avg(has_equal_outputs::INT) FILTER (side = 'in'), 4) + 0.0 AS frac_equal_outputs, (sum(is_coinbase::INT) FILTER (side = 'out'))::BIGINT AS n_coinbase_received, ((sum(sats) FILTER (side = 'out')) - (sum(sats) FILTER (side = 'in')))::BIGINT AS balance_sats FROM rows_ GROUP BY subject_id""",
    "ftr04_counterparties": f"WITH {WIN} SELECT a.subject_id, count(DISTINCT b.address) AS n_counterparties FROM rows_ a JOIN rows_ b ON a.txid = b.txid AND a.address <> b.address GROUP BY a.subject_id",
    "ftr05_max_fan_out": f"WITH {WIN} SELECT subject_id, max(n) AS max_fan_out FROM (SELECT subject_id, txid, count(DISTINCT address) AS n FROM rows_ WHERE side = 'in' GROUP BY ALL) GROUP BY subject_id",
    "ftr06_dwell": f"""WITH {WIN}, g AS (SELECT subject_id, address, txid, first_seen_us AS t FROM rows_ WHERE side = 'out'), s AS (SELECT DISTINCT address, first_seen_us AS t FROM rows_ WHERE side = 'in')
      SELECT g.subject_id, trunc(median(s.t - g.t))::BIGINT AS median_dwell_us FROM g ASOF JOIN s ON g.address = s.address AND g.t <= s.t GROUP BY g.subject_id""",
    "ftr07_cluster_shape": f"""WITH {WIN}, {base.CLAIMS}, live AS (SELECT * FROM subject_map WHERE address IN (SELECT address FROM rows_)),
      held AS (SELECT l.subject_id, confidence, evidence FROM claims c JOIN live l ON l.address = c.src JOIN live r ON r.address = c.dst AND r.subject_id = l.subject_id)
      SELECT subject_id, n_addresses, min_edge_confidence, n_heuristics FROM (SELECT subject_id, count(*) AS n_addresses FROM live GROUP BY subject_id)
      LEFT JOIN (SELECT subject_id, min(confidence) AS min_edge_confidence, count(DISTINCT evidence) AS n_heuristics FROM held GROUP BY subject_id) USING (subject_id)""",
    "ftr09_origin_fusion": f"""WITH {CAND}, {FIRST}, {WIN.replace(base.TX + ', ', '', 1)} SELECT p.subject_id, round(avg(p_origin), 6) + 0.0 AS mean_p_origin, round(avg(margin), 6) + 0.0 AS mean_origin_margin, round(avg(n_announcements), 6) + 0.0 AS mean_n_announcements,
      round(avg(is_tor_exit::INT), 6) + 0.0 AS frac_top1_tor, round(avg(CASE WHEN e.txid IS NULL THEN 1 ELSE 0 END), 6) + 0.0 AS frac_origin_abstained FROM pairs p LEFT JOIN (SELECT * FROM est WHERE rank = 1) e USING (txid) GROUP BY p.subject_id""",
    "ftr10_operator_fusion": f"""WITH {ROLLUP}, {WIN.replace(base.TX + ', ', '', 1)} SELECT subject_id, round(avg(p_asn), 6) + 0.0 AS mean_p_asn, round(avg(margin), 6) + 0.0 AS mean_asn_margin, round(avg((abstain_reason IS NOT NULL)::INT), 6) + 0.0 AS frac_l1_abstained
      FROM pairs JOIN rolled USING (txid) GROUP BY subject_id""",
    "ftr11_typology_load": f"""WITH {WIN}, {network.HITS} SELECT h.subject_id, count(DISTINCT typology) AS n_typologies, count(DISTINCT p.txid) AS n_typology_txns
      FROM (SELECT subject_id, typology, unnest(string_split(txids, ',')) AS txid FROM h) h JOIN pairs p ON p.subject_id = h.subject_id AND p.txid = h.txid GROUP BY h.subject_id""",
    "ftr12_morphology": f"""WITH {WIN}, {MORPH} SELECT subject_id, fan_in_ratio, peel_chain_depth, round(peel_leak_frac, 6) + 0.0 AS peel_leak_frac, round(structuring_frac, 6) + 0.0 AS structuring_frac,
      round(burstiness, 6) + 0.0 AS burstiness, round(fee_anomaly, 6) + 0.0 AS fee_anomaly FROM morph""",
    "ftr15_flows": f"""WITH {base.SIDES}, {network.SUBJECTS}, {FLOWS} SELECT * REPLACE (round(mean_sent_sats, 4) + 0.0 AS mean_sent_sats, round(mean_fee_rate, 4) + 0.0 AS mean_fee_rate, round(frac_equal_outputs, 4) + 0.0 AS frac_equal_outputs, round(mean_received_sats, 4) + 0.0 AS mean_received_sats) FROM flows""",
    "ftr16_pooled": f"""WITH {WIN} SELECT subject_id, round(ln(1 + count(*)), 5) + 0.0 AS spent_degree, round(avg(n_out), 5) + 0.0 AS spent_n_out_mean, round(stddev_pop(n_out), 5) + 0.0 AS spent_n_out_std, round(min(n_out)::DOUBLE, 5) + 0.0 AS spent_n_out_min, round(max(n_out)::DOUBLE, 5) + 0.0 AS spent_n_out_max,
      round(avg(f), 5) + 0.0 AS spent_fee_rate_sat_vb_mean, round(stddev_pop(f), 5) + 0.0 AS spent_fee_rate_sat_vb_std, round(min(f), 5) + 0.0 AS spent_fee_rate_sat_vb_min, round(max(f), 5) + 0.0 AS spent_fee_rate_sat_vb_max
      FROM (SELECT subject_id, n_out, coalesce(fee_rate_sat_vb, 0) AS f FROM pairs JOIN tx USING (txid)) GROUP BY subject_id""",
    "ftr17_signed_log": f"""WITH {base.SIDES}, {network.SUBJECTS}, {FLOWS} SELECT subject_id, round(sign(balance_sats) * ln(1 + abs(balance_sats)), 6) + 0.0 AS balance_log,
      round(sign(coalesce(mean_sent_sats, 0)) * ln(1 + abs(coalesce(mean_sent_sats, 0))), 6) + 0.0 AS mean_sent_log FROM flows""",
}
_TYPES = "CASE WHEN address LIKE 'bc1p%' THEN 'p2tr' WHEN address LIKE 'bc1q%' AND length(address) = 42 THEN 'p2wpkh' WHEN address LIKE 'bc1q%' AND length(address) = 62 THEN 'p2wsh' WHEN address LIKE '3%' THEN 'p2sh' WHEN address LIKE '1%' THEN 'p2pkh' END"
_WINDOW_TYPES = f"WITH {WIN} SELECT subject_id, count(DISTINCT {_TYPES}) + max(({_TYPES} IS NULL)::INT) AS n_script_types FROM (SELECT DISTINCT subject_id, address FROM rows_) GROUP BY subject_id"


def _columns(names) -> str:
    """The features by name: nothing found is zero in some, fractions are rounded."""
    fraction = {"min_edge_confidence"}
    out = []
    for c in names:
        x = f"coalesce({c}, 0)" if c in features.ZERO_FILLED else c
        out.append(f"round({x}, 4) + 0.0 AS {c}" if c in fraction else f"{x} AS {c}")
    return ", ".join(out)


def _blocks(names: list[str]) -> str:
    four = lambda q: (_WINDOW_TYPES if q == "types" else ORACLES[q]).replace(", 6)", ", 4)")
    return f"({four(names[0])}) b0 " + " ".join(f"LEFT JOIN ({four(q)}) b{i} USING (subject_id)" for i, q in enumerate(names[1:], 1))


_PLAIN = ["ftr03_activity", "ftr04_counterparties", "ftr05_max_fan_out", "ftr06_dwell", "ftr07_cluster_shape", "types", "ftr12_morphology"]
ORACLES["ftr13_subject_table"] = f"""SELECT subject_id, "window" = 'train' AS is_train, {_columns(features.SUBJECT_FEATURES)}
  FROM {_blocks([*_PLAIN, "ftr09_origin_fusion", "ftr10_operator_fusion", "ftr11_typology_load", "ftr02_windows"])}"""
_SNAP_TX = f"tx AS (SELECT DISTINCT * FROM normalised_transactions WHERE first_seen_us BETWEEN {SNAPSHOT[0]} AND {SNAPSHOT[1]})"
_SNAP_SUBJECTS = f"""known AS (SELECT src, dst, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, ts_us, txid NULLS FIRST, evidence) AS r
      FROM ({base.CLAIMS.split("AS (", 1)[1][:-1]}) WHERE ts_us <= {SNAPSHOT[1]}) WHERE r = 1 AND confidence >= 0.3),
  both_ways AS (SELECT src AS u, dst AS v FROM known UNION SELECT dst, src FROM known),
  far(member, r) AS (SELECT DISTINCT u, u FROM both_ways UNION SELECT far.member, both_ways.v FROM far JOIN both_ways ON both_ways.u = far.r),
  grouped AS (SELECT member AS address, 'group:' || min(r) AS subject_id FROM far GROUP BY member),
  subject_map AS (SELECT subject_id, address FROM grouped UNION ALL SELECT 'addr:' || address, address FROM (SELECT DISTINCT address FROM sides) s WHERE address NOT IN (SELECT address FROM grouped))"""


def _snapshot_sql(sql: str) -> str:
    sql = sql.replace(base.TX, _SNAP_TX).replace(network.SUBJECTS, _SNAP_SUBJECTS).replace(str(BOUNDARY_US), str(SNAPSHOT[1] + 1)).replace("FROM claims c", "FROM known c")
    return sql.replace("WITH ", "WITH RECURSIVE ")


ORACLES["ftr15_snapshot"] = _snapshot_sql(f"""SELECT subject_id, {_columns([c for c in features.SUBJECT_FEATURES if c not in features.FUSED])}
  FROM (SELECT * EXCLUDE (total_sent_sats, mean_sent_sats, total_received_sats, mean_received_sats, balance_sats, n_counterparties, mean_fee_rate, frac_equal_outputs) FROM {_blocks(_PLAIN)}) p
  LEFT JOIN ({ORACLES["ftr15_flows"]}) f USING (subject_id)""")

# All instants form one window: the twin of the relational features reuses the blocks with a boundary beyond all of them.
_ALL_TX = "tx AS (SELECT DISTINCT * FROM normalised_transactions WHERE first_seen_us IS NOT NULL)"
_OWN = [c for c in features.SUBJECT_FEATURES if c not in features.FUSED]
_OF_TX = ["n_in", "n_out", "total_out_sats", "fee_sats", "fee_rate_sat_vb", "has_equal_outputs"]
_OF_PEER = ["observations", "transactions", "observers", *[f"class_{i}" for i in range(6)]]


def _relational_sql() -> str:
    whole = lambda sql: sql.replace(base.TX, _ALL_TX).replace(str(BOUNDARY_US), str(9 * 10**18))
    blocks = _blocks(_PLAIN).replace(", 4) + 0.0", ", 12) + 0.0")
    flows = ORACLES["ftr15_flows"].replace(", 4) + 0.0", ", 12) + 0.0")
    local = f"""SELECT subject_id, {", ".join(_OWN)} FROM (SELECT * EXCLUDE (total_sent_sats, mean_sent_sats, total_received_sats, mean_received_sats, balance_sats, n_counterparties, mean_fee_rate, frac_equal_outputs) FROM {blocks}) p
      LEFT JOIN ({flows}) f USING (subject_id)"""
    number = lambda c: f"coalesce(CASE WHEN isnan({c}::DOUBLE) THEN 0 ELSE {c}::DOUBLE END, 0)"
    signed = ", ".join(f"sign({number(c)}) * ln(1 + abs({number(c)})) AS {c}" for c in _OWN)
    values = ", ".join(f"max(ln(1 + greatest({number(c)}, 0))) AS {c}" for c in _OF_TX)
    code = "CASE net_class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in origin.CLASS_CODES.items()) + " ELSE 0 END"
    classes = ", ".join(f"(({code}) = {i})::INT::DOUBLE AS class_{i}" for i in range(6))
    fields = [*_OF_TX, *[f"announcer_mean_{c}" for c in _OF_PEER], *[f"funder_mean_{c}" for c in _OWN]]
    context = ", ".join([*[f"v.{c}" for c in _OF_TX], *[f"coalesce(announcer_mean_{c}, 0) AS announcer_mean_{c}" for c in _OF_PEER], *[f"coalesce(funder_mean_{c}, 0) AS funder_mean_{c}" for c in _OWN]])
    pooled = lambda side: f"ln(1 + count(*)) AS {side}_degree, " + ", ".join(f"avg({c}) AS {side}_{c}_mean, stddev_pop({c}) AS {side}_{c}_std, min({c}) AS {side}_{c}_min, max({c}) AS {side}_{c}_max" for c in fields)
    names = [*_OWN, *[f"{side}_{c}" for side in ("received", "spent") for c in ["degree", *[f"{f}_{a}" for f in fields for a in ("mean", "std", "min", "max")]]]]
    link = lambda column: f"SELECT DISTINCT subject_id, txid FROM (SELECT txid, unnest({column}) AS address FROM tx) JOIN subject_map USING (address) WHERE subject_id IN (SELECT subject_id FROM logs)"
    return whole(f"""WITH {base.PEERS}, {base.SIDES}, {network.SUBJECTS}, local AS ({local}), logs AS (SELECT subject_id, {signed} FROM local), vals AS (SELECT txid, {values} FROM tx GROUP BY txid),
      heard AS (SELECT a.* FROM ann a JOIN vals USING (txid)),
      announcers AS (SELECT c.peer_ip, ln(1 + observations) AS observations, ln(1 + transactions) AS transactions, ln(1 + observers) AS observers, {classes} FROM (
        SELECT peer_ip, count(*) AS observations, count(DISTINCT txid) AS transactions, count(DISTINCT observer_ip) AS observers FROM heard GROUP BY peer_ip) c LEFT JOIN peers p ON p.peer_ip = c.peer_ip),
      said AS (SELECT txid, {", ".join(f"avg({c}) AS announcer_mean_{c}" for c in _OF_PEER)} FROM (SELECT DISTINCT peer_ip, txid FROM heard) JOIN announcers USING (peer_ip) GROUP BY txid),
      funds AS ({link("input_addresses")}), receives AS ({link("output_addresses")}),
      funded AS (SELECT txid, {", ".join(f"avg({c}) AS funder_mean_{c}" for c in _OWN)} FROM funds JOIN logs USING (subject_id) GROUP BY txid),
      context AS (SELECT v.txid, {context} FROM vals v LEFT JOIN said USING (txid) LEFT JOIN funded USING (txid)),
      received AS (SELECT subject_id, {pooled("received")} FROM receives JOIN context USING (txid) GROUP BY subject_id), spent AS (SELECT subject_id, {pooled("spent")} FROM funds JOIN context USING (txid) GROUP BY subject_id)
      SELECT subject_id, {", ".join(f"round(coalesce({c}, 0), 5) + 0.0 AS {c}" for c in names)} FROM logs LEFT JOIN received USING (subject_id) LEFT JOIN spent USING (subject_id)""")


ORACLES["ftr16_relational"] = _relational_sql()
