"""Tables as the operators expect them, from the driver's tables, and the same as SQL.

* announcements: ``sealed`` rows with an instant and a txid
* peer facts: one row per peer of ``origin_abstain``
* transactions: the distinct rows of ``normalised_transactions``
* claims: ``edges`` rows that say something about ownership
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators import normalise
from peerlens.runtime import table


def sealed(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "sealed")


def ann(spark: SparkSession, root: str) -> DataFrame:
    return normalise.announcements(sealed(spark, root))


def facts(spark: SparkSession, root: str) -> DataFrame:
    return normalise.peer_facts(table(spark, root, "origin_abstain"))


def peers(spark: SparkSession, root: str) -> DataFrame:
    return normalise.peers(ann(spark, root), facts(spark, root))


def enriched(spark: SparkSession, root: str) -> DataFrame:
    return normalise.enriched(ann(spark, root), peers(spark, root))


def asn_rollup(spark: SparkSession, root: str) -> DataFrame:
    return normalise.asn_rollup(peers(spark, root), enriched(spark, root))


def tx(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "normalised_transactions").distinct()


def claims(spark: SparkSession, root: str) -> DataFrame:
    """Ownership claims with both ends, undirected pairs in (src, dst) order."""
    e = table(spark, root, "edges").where((F.col("kind") == "SAME_OWNER") & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")) & F.col("confidence").isNotNull())
    return e.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "ts_us", "txid", "confidence", F.coalesce(F.lower("evidence"), F.lit("unknown")).alias("evidence"), "edge_id")


ANN = """ann AS (
  SELECT row_id, txid, src_ip AS peer_ip, src_port AS peer_port, dst_ip AS observer_ip, dst_port AS observer_port, ts_us AS seen_us,
         observer_id, geo_country, asn, msg_type,
         rank() OVER (PARTITION BY txid ORDER BY ts_us) AS rank_in_tx,
         ts_us - min(ts_us) OVER (PARTITION BY txid) AS delta_first_us
  FROM sealed WHERE ts_us IS NOT NULL AND txid IS NOT NULL)"""
FACTS = """facts AS (
  SELECT peer_ip, min(asn) AS v_asn, min(as_org) AS v_as_org, min(net_class) AS v_net_class, min(geo_country) AS v_geo_country
  FROM origin_abstain WHERE peer_ip IS NOT NULL GROUP BY peer_ip)"""
PEERS = f"""{ANN}, {FACTS}, peers AS (
  SELECT o.peer_ip, n_announcements, n_txids, mean_rank, frac_rank_one, distinct_ports,
         coalesce(o.geo_country, f.v_geo_country) AS geo_country, coalesce(o.asn, f.v_asn) AS asn,
         f.v_as_org AS as_org, f.v_net_class AS net_class, first_us, last_us
  FROM (SELECT peer_ip, count(*) AS n_announcements, count(DISTINCT txid) AS n_txids, avg(rank_in_tx) AS mean_rank,
               avg((rank_in_tx = 1)::INT) AS frac_rank_one, count(DISTINCT peer_port) AS distinct_ports,
               arg_min(geo_country, row_id) FILTER (geo_country IS NOT NULL) AS geo_country,
               arg_min(asn, row_id) FILTER (asn IS NOT NULL) AS asn, min(seen_us) AS first_us, max(seen_us) AS last_us
        FROM ann GROUP BY peer_ip) o LEFT JOIN facts f USING (peer_ip))"""
ENRICHED = f"""{PEERS}, enriched AS (
  SELECT a.row_id, a.txid, a.peer_ip, a.observer_ip, a.observer_id, a.seen_us, a.rank_in_tx, a.delta_first_us,
         coalesce(a.geo_country, p.geo_country) AS geo_country, coalesce(a.asn, p.asn) AS asn, p.as_org, p.net_class, p.n_txids AS peer_seen_count
  FROM ann a LEFT JOIN peers p USING (peer_ip))"""
ASN = f"""{ENRICHED}, asn_rollup AS (
  SELECT q.*, n_announcements, n_txids, frac_rank_one FROM (
    SELECT asn, min(as_org) AS as_org, min(geo_country) AS geo_country, count(*) AS n_peers,
           count(*) FILTER (net_class = 'hosting') AS n_hosting, count(*) FILTER (net_class = 'mobile') AS n_mobile,
           count(*) FILTER (net_class = 'residential') AS n_residential, count(*) FILTER (net_class = 'tor') AS n_tor,
           count(*) FILTER (net_class = 'unknown') AS n_unknown, count(*) FILTER (net_class = 'vpn_suspect') AS n_vpn_suspect
    FROM peers GROUP BY asn) q
  LEFT JOIN (SELECT asn AS asn2, count(*) AS n_announcements, count(DISTINCT txid) AS n_txids, avg((rank_in_tx = 1)::INT) AS frac_rank_one
             FROM enriched GROUP BY asn) r ON q.asn IS NOT DISTINCT FROM r.asn2)"""
TX = "tx AS (SELECT DISTINCT * FROM normalised_transactions)"
CLAIMS = """claims AS (
  SELECT least(a, b) AS src, greatest(a, b) AS dst, ts_us, txid, confidence, coalesce(lower(evidence), 'unknown') AS evidence, edge_id
  FROM edges WHERE kind = 'SAME_OWNER' AND a IS NOT NULL AND b IS NOT NULL AND a <> b AND confidence IS NOT NULL)"""
SIDES = f"""{TX}, sides AS (
  SELECT address, txid, side, sats, at_us FROM (
    SELECT txid, first_seen_us AS at_us, 'in' AS side, unnest(input_addresses) AS address, unnest(input_amounts) AS sats FROM tx
    UNION ALL
    SELECT txid, first_seen_us, 'out', unnest(output_addresses), unnest(output_amounts) FROM tx) WHERE address IS NOT NULL)"""
