"""Queries of the normalisation operators, as-of joins and interval lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.functions import text
from peerlens.operators import asof, normalise
from peerlens.plans import base
from peerlens.runtime import table

R = 9  # digits kept of doubles


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def nrm01_announcements(spark: SparkSession, root: str) -> DataFrame:
    return _long(base.ann(spark, root), "peer_port", "observer_port", "asn", "rank_in_tx")


def nrm02_peers(spark: SparkSession, root: str) -> DataFrame:
    p = base.peers(spark, root)
    return _long(p.withColumns({c: F.round(c, R) for c in ("mean_rank", "frac_rank_one")}), "asn")


def nrm03_enriched(spark: SparkSession, root: str) -> DataFrame:
    e = base.enriched(spark, root)
    return _long(e.select("row_id", "txid", "peer_ip", "seen_us", "geo_country", "asn", "as_org", "net_class", "peer_seen_count"), "asn")


def nrm04_asn_rollup(spark: SparkSession, root: str) -> DataFrame:
    return _long(base.asn_rollup(spark, root).withColumn("frac_rank_one", F.round("frac_rank_one", R)), "asn")


def nrm05_arrival(spark: SparkSession, root: str) -> DataFrame:
    return normalise.arrival(base.ann(spark, root))


def _whole_amounts(spark: SparkSession, root: str) -> DataFrame:
    whole = lambda c: F.transform(c, lambda x: F.when(x.rlike("^[0-9]{1,18}$"), x.cast("bigint")))
    return base.sealed(spark, root).withColumn("input_amounts", whole("input_amounts")).withColumn("output_amounts", whole("output_amounts"))


def nrm06_transactions(spark: SparkSession, root: str) -> DataFrame:
    t = normalise.transactions(_whole_amounts(spark, root))
    t = t.select(
        "txid", "first_seen_us", "last_seen_us", "n_announcements", "n_distinct_peers", "announce_spread_us", "n_in", "n_out", "is_coinbase",
        "has_equal_outputs", "total_in_sats", "total_out_sats", "fee_sats", F.round("fee_rate_sat_vb", R).alias("fee_rate_sat_vb"), "change_index",
    )
    return _long(t, "n_in", "n_out", "change_index")


def nrm07_change_index(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root).where(F.col("output_amounts").isNotNull())
    return t.select("txid", normalise.change_index().cast("long").alias("change_at"))


def nrm08_addresses(spark: SparkSession, root: str) -> DataFrame:
    return normalise.addresses(base.tx(spark, root)).drop("dwell_time_us", "script_type")


def nrm09_dwell(spark: SparkSession, root: str) -> DataFrame:
    return normalise.dwell_times(normalise.sides(base.tx(spark, root)))


def nrm10_script_types(spark: SparkSession, root: str) -> DataFrame:
    d = normalise.declared_script_types(base.sealed(spark, root)).withColumnRenamed("script_type", "declared")
    return d.withColumn("own", text.script_type(F.col("address"))).withColumn("script_type", F.coalesce("declared", "own"))


def nrm11_net_class(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "origin_abstain").where("peer_ip is not null").groupBy("peer_ip").agg(F.min("as_org").alias("org"), F.bool_or(F.coalesce(F.col("net_class") == "tor", F.lit(False))).alias("is_tor"))
    return f.select("peer_ip", text.net_class(F.col("org"), F.col("is_tor"), F.lit(False), F.lit(True), F.lit(True)).alias("net_class"))


def nrm12_peer_facts(spark: SparkSession, root: str) -> DataFrame:
    return _long(base.facts(spark, root), "v_asn")


def joi06_asof_backward(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", F.col("us").alias("click_us"))
    views = e.where("event_type = 'view'").select("user_id", F.col("us").alias("view_us"))
    return _long(asof.asof_join(clicks, views, ["user_id"], "click_us", "view_us", []), "event_id", "user_id")


def joi07_asof_forward(spark: SparkSession, root: str) -> DataFrame:
    rows = normalise.sides(base.tx(spark, root)).where("at_us is not null")
    got = rows.where("side = 'out'").select("address", "txid", F.col("at_us").alias("received_us"))
    sent = rows.where("side = 'in'").select("address", F.col("at_us").alias("next_send_us"))
    return asof.asof_join(got, sent, ["address"], "received_us", "next_send_us", [], direction="forward").distinct()


def joi08_asof_strict(spark: SparkSession, root: str) -> DataFrame:
    a = base.ann(spark, root)
    left = a.select("row_id", "peer_ip", "seen_us")
    right = a.select("peer_ip", F.col("seen_us").alias("before_us"))
    return asof.asof_join(left, right, ["peer_ip"], "seen_us", "before_us", [], strict=True)


def joi09_cidr_lookup(spark: SparkSession, root: str) -> DataFrame:
    ips = base.sealed(spark, root).select(F.col("src_ip").alias("ip")).union(base.sealed(spark, root).select("dst_ip")).where("ip is not null").distinct()
    blocks = spark.createDataFrame([("198.18.0.0/17", "low"), ("198.18.128.0/17", "mid"), ("198.19.0.0/16", "high"), ("192.0.2.16/28", "doc"), ("2001:db8::/40", "six"), ("bad/99", "bad"), ("300.1.1.1/8", "worse")], "network string, zone string")
    return asof.cidr_lookup(ips, blocks, "ip", "network", ["zone"])


QUERIES = {f.__name__: f for f in (
    nrm01_announcements, nrm02_peers, nrm03_enriched, nrm04_asn_rollup, nrm05_arrival, nrm06_transactions, nrm07_change_index, nrm08_addresses, nrm09_dwell,
    nrm10_script_types, nrm11_net_class, nrm12_peer_facts, joi06_asof_backward, joi07_asof_forward, joi08_asof_strict, joi09_cidr_lookup,
)}

_OWN = "CASE WHEN address LIKE 'bc1p%' THEN 'p2tr' WHEN address LIKE 'bc1q%' AND length(address) = 42 THEN 'p2wpkh' WHEN address LIKE 'bc1q%' AND length(address) = 62 THEN 'p2wsh' WHEN address LIKE '3%' THEN 'p2sh' WHEN address LIKE '1%' THEN 'p2pkh' END"
_CHANGE = """len(list_filter(list_zip(output_amounts, output_addresses), lambda x: x[1] % 1000 <> 0 AND NOT list_contains(input_addresses, x[2])))"""

ORACLES = {
    "nrm01_announcements": f"WITH {base.ANN} SELECT * FROM ann",
    "nrm02_peers": f"WITH {base.PEERS} SELECT * REPLACE (round(mean_rank, {R}) AS mean_rank, round(frac_rank_one, {R}) AS frac_rank_one) FROM peers",
    "nrm03_enriched": f"WITH {base.ENRICHED} SELECT row_id, txid, peer_ip, seen_us, geo_country, asn, as_org, net_class, peer_seen_count FROM enriched",
    "nrm04_asn_rollup": f"WITH {base.ASN} SELECT * REPLACE (round(frac_rank_one, {R}) AS frac_rank_one) FROM asn_rollup",
    "nrm05_arrival": f"WITH {base.ANN} SELECT txid, observer_id, peer_ip, seen_us FROM ann",
    "nrm06_transactions": f"""
      WITH s AS (SELECT *, list_transform(input_amounts, lambda x: CASE WHEN regexp_full_match(x, '[0-9]{{1,18}}') THEN x::BIGINT END) AS ia,
                        list_transform(output_amounts, lambda x: CASE WHEN regexp_full_match(x, '[0-9]{{1,18}}') THEN x::BIGINT END) AS oa
                 FROM sealed WHERE txid IS NOT NULL),
      g AS (SELECT txid, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, count(*) AS n_announcements, count(DISTINCT src_ip) AS n_distinct_peers,
                   min(row_id) AS r FROM s GROUP BY txid),
      t AS (SELECT g.txid, first_seen_us, last_seen_us, n_announcements, n_distinct_peers, last_seen_us - first_seen_us AS announce_spread_us,
                   len(input_addresses) AS n_in, len(output_addresses) AS n_out, len(input_addresses) = 0 AS is_coinbase,
                   len(list_distinct(oa)) + (CASE WHEN len(list_filter(oa, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END) < len(oa) AS has_equal_outputs,
                   coalesce(list_sum(ia), 0)::BIGINT AS total_in_sats, coalesce(list_sum(oa), 0)::BIGINT AS total_out_sats, vsize, input_addresses,
                   list_zip(oa, output_addresses, range(len(oa))) AS z
            FROM g JOIN s ON s.row_id = g.r AND s.txid = g.txid),
      f AS (SELECT *, CASE WHEN is_coinbase THEN 0 ELSE total_in_sats - total_out_sats END AS fee_sats,
                   list_filter(z, lambda x: x[1] % 1000 <> 0 AND NOT list_contains(input_addresses, x[2])) AS c FROM t)
      SELECT txid, first_seen_us, last_seen_us, n_announcements, n_distinct_peers, announce_spread_us, n_in, n_out, is_coinbase, has_equal_outputs,
             total_in_sats, total_out_sats, fee_sats, round(CASE WHEN vsize > 0 THEN fee_sats / vsize END, {R}) AS fee_rate_sat_vb,
             CASE WHEN len(c) = 1 AND n_out >= 2 THEN c[1][3] ELSE -1 END::BIGINT AS change_index FROM f""",
    "nrm07_change_index": f"""
      WITH {base.TX}, z AS (SELECT txid, len(output_addresses) AS n, list_filter(list_zip(output_amounts, output_addresses, range(len(output_amounts))),
             lambda x: x[1] % 1000 <> 0 AND NOT list_contains(input_addresses, x[2])) AS c FROM tx WHERE output_amounts IS NOT NULL)
      SELECT txid, CASE WHEN len(c) = 1 AND n >= 2 THEN c[1][3] ELSE -1 END::BIGINT AS change_at FROM z""",
    "nrm08_addresses": f"""
      WITH {base.SIDES}
      SELECT address, min(at_us) AS first_seen_us, max(at_us) AS last_seen_us, count(DISTINCT txid) FILTER (side = 'out') AS n_tx_in,
             count(DISTINCT txid) FILTER (side = 'in') AS n_tx_out, coalesce(sum(sats) FILTER (side = 'out'), 0)::BIGINT AS total_received_sats,
             coalesce(sum(sats) FILTER (side = 'in'), 0)::BIGINT AS total_sent_sats,
             (coalesce(sum(sats) FILTER (side = 'out'), 0) - coalesce(sum(sats) FILTER (side = 'in'), 0))::BIGINT AS balance_sats
      FROM sides GROUP BY address""",
    "nrm09_dwell": f"""
      WITH {base.SIDES}, s AS (SELECT address, at_us FROM sides WHERE side = 'in' AND at_us IS NOT NULL),
      r AS (SELECT DISTINCT address, at_us FROM sides WHERE side = 'out' AND at_us IS NOT NULL)
      SELECT s.address, trunc(median(s.at_us - r.at_us))::BIGINT AS dwell_time_us
      FROM s ASOF JOIN r ON s.address = r.address AND s.at_us >= r.at_us GROUP BY s.address""",
    "nrm10_script_types": f"""
      WITH d AS (SELECT address, arg_min(kind, row_id) FILTER (kind IS NOT NULL) AS declared FROM (
        SELECT row_id, unnest(output_addresses) AS address, unnest(script_types) AS kind FROM sealed WHERE len(script_types) = len(output_addresses))
        WHERE address IS NOT NULL GROUP BY address)
      SELECT address, declared, {_OWN} AS own, coalesce(declared, {_OWN}) AS script_type FROM d""",
    "nrm11_net_class": """
      WITH f AS (SELECT peer_ip, lower(min(as_org)) AS o, bool_or(coalesce(net_class = 'tor', false)) AS t FROM origin_abstain WHERE peer_ip IS NOT NULL GROUP BY peer_ip)
      SELECT peer_ip, CASE WHEN t THEN 'tor_exit' WHEN o IS NULL THEN 'unknown'
        WHEN regexp_matches(o, 'vpn|proxy|privacy|anonym|tunnel|mullvad|private internet') THEN 'vpn_suspect'
        WHEN regexp_matches(o, 'mobile|cellular|wireless|gsm|lte') THEN 'mobile'
        WHEN regexp_matches(o, 'hosting|cloud|data center|datacenter|data centre|server|vps|dedicated|colocation|amazon|google|microsoft|digitalocean|ovh|hetzner|linode|vultr|alibaba|oracle') THEN 'hosting'
        ELSE 'residential' END AS net_class FROM f""",
    "nrm12_peer_facts": f"WITH {base.FACTS} SELECT * FROM facts",
    "joi06_asof_backward": """
      WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events), v AS (SELECT DISTINCT user_id, us FROM e WHERE event_type = 'view')
      SELECT event_id, c.user_id, c.us AS click_us, v.us AS view_us FROM (SELECT * FROM e WHERE event_type = 'click') c
      ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.us >= v.us""",
    "joi07_asof_forward": f"""
      WITH {base.SIDES}, g AS (SELECT DISTINCT address, txid, at_us FROM sides WHERE side = 'out' AND at_us IS NOT NULL),
      s AS (SELECT DISTINCT address, at_us FROM sides WHERE side = 'in' AND at_us IS NOT NULL)
      SELECT g.address, g.txid, g.at_us AS received_us, s.at_us AS next_send_us FROM g ASOF LEFT JOIN s ON g.address = s.address AND g.at_us <= s.at_us""",
    "joi08_asof_strict": f"""
      WITH {base.ANN}, r AS (SELECT DISTINCT peer_ip, seen_us FROM ann)
      SELECT a.row_id, a.peer_ip, a.seen_us, r.seen_us AS before_us FROM ann a ASOF LEFT JOIN r ON a.peer_ip = r.peer_ip AND a.seen_us > r.seen_us""",
    "joi09_cidr_lookup": """
      WITH ips AS (SELECT src_ip AS ip FROM sealed WHERE src_ip IS NOT NULL UNION SELECT dst_ip FROM sealed WHERE dst_ip IS NOT NULL),
      n AS (SELECT ip, CASE WHEN ip NOT LIKE '%:%' THEN split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END AS k FROM ips)
      SELECT ip, CASE WHEN k BETWEEN 3323068416 AND 3323101183 THEN 'low' WHEN k BETWEEN 3323101184 AND 3323133951 THEN 'mid' WHEN k BETWEEN 3323133952 AND 3323199487 THEN 'high'
        WHEN k BETWEEN 3221226000 AND 3221226015 THEN 'doc' WHEN k IS NULL AND regexp_matches(ip, '^2001:db8:0{0,1}:') AND NOT regexp_matches(ip, '^2001:db8:[0-9a-f]{3,4}:') THEN 'six' END AS zone FROM n""",
}
