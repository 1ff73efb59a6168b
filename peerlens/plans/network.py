"""Queries of the graph, ownership, peel-chain and typology operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators import graph, normalise, peel, typology
from peerlens.plans import base
from peerlens.runtime import table

CUTOFF_US = 1_750_000_000_000_000  # a point in mid-2025 for point-in-time queries


def _round(df: DataFrame, *cols: str, n: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def shaped_tx(spark: SparkSession, root: str) -> DataFrame:
    """Transactions with the change index computed afresh."""
    t = base.tx(spark, root)
    return t.withColumn("change_index", F.when(F.col("output_amounts").isNull(), -1).otherwise(normalise.change_index()))


def grf01_nodes(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root)
    return graph.nodes(normalise.sides(t).groupBy("address").agg(F.min("at_us").alias("first_seen_us"), F.max("at_us").alias("last_seen_us")), t, base.peers(spark, root))


def grf02_flows(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root)
    return graph.spends(t).unionByName(graph.receives(t))


def grf03_announced_by(spark: SparkSession, root: str) -> DataFrame:
    return graph.announced_by(base.ann(spark, root))


def grf04_hosted_in(spark: SparkSession, root: str) -> DataFrame:
    own = base.ann(spark, root).where("asn is not null").select("peer_ip").distinct()
    return graph.hosted_in(base.peers(spark, root), own)


def grf05_mixers(spark: SparkSession, root: str) -> DataFrame:
    """Every transaction with whether it looks like a joint one."""
    return base.tx(spark, root).select("txid", F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"), "has_equal_outputs", graph.mixer().alias("is_mixer"))


def grf06_star_edges(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "clusters")
    return graph.star_edges(c, F.col("addresses"), "run", 1.0, keep=("cluster_id",))


def grf07_multi_input(spark: SparkSession, root: str) -> DataFrame:
    return graph.multi_input_claims(shaped_tx(spark, root))


def grf08_change_claims(spark: SparkSession, root: str) -> DataFrame:
    return graph.change_claims(shaped_tx(spark, root))


def grf09_suppressed(spark: SparkSession, root: str) -> DataFrame:
    """What the mixer rule would suppress if unequal outputs counted too; the tables have no transaction that meets it whole."""
    return graph.suppressed_claims(shaped_tx(spark, root), (F.col("n_out") >= 3) & (F.col("n_in") >= 2))


def grf10_strongest(spark: SparkSession, root: str) -> DataFrame:
    return graph.strongest(base.claims(spark, root))


def grf11_clusters(spark: SparkSession, root: str) -> DataFrame:
    return graph.clusters(graph.strongest(base.claims(spark, root))).select("member", "root", "cluster_id")


def grf12_cluster_facts(spark: SparkSession, root: str) -> DataFrame:
    e = graph.strongest(base.claims(spark, root))
    return graph.cluster_facts(graph.clusters(e), e).withColumn("heuristics_used", F.array_join("heuristics_used", ","))


def grf13_peel_hops(spark: SparkSession, root: str) -> DataFrame:
    return peel.hops(base.tx(spark, root))


def grf15_peel_links(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root)
    return peel.links(t, peel.hops(t)).select("txid", "next", "stop_reason")


def grf16_peel_chains(spark: SparkSession, root: str) -> DataFrame:
    return _round(peel.chains(base.tx(spark, root), min_depth=1), "leak_frac").withColumn("transactions", F.array_join("transactions", ","))


def grf18_marked_nodes(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root)
    chain = peel.chains(t, min_depth=1).select(F.col("root").alias("peel_chain_id"), F.explode("transactions").alias("txid"))
    return t.select("txid", F.coalesce(graph.mixer(), F.lit(False)).alias("coinjoin")).join(chain, "txid", "left")


def grf19_ledger(spark: SparkSession, root: str) -> DataFrame:
    return graph.ledger(shaped_tx(spark, root))


def grf20_snapshot(spark: SparkSession, root: str) -> DataFrame:
    c = base.claims(spark, root).select("src", "dst", "txid", F.col("ts_us").alias("available_us"), "confidence", "evidence")
    return graph.snapshot(c, CUTOFF_US)


def joi11_neighbourhood(spark: SparkSession, root: str) -> DataFrame:
    e = graph.announced_by(base.ann(spark, root)).select("src", "dst", "kind", "ts_us")
    focus = base.ann(spark, root).where("geo_country = 'DE'").select(F.concat(F.lit("peer:"), "peer_ip").alias("node_id")).distinct()
    return graph.neighbourhood(e, focus)


def org01_peer_degree(spark: SparkSession, root: str) -> DataFrame:
    p = base.peers(spark, root)
    own = base.ann(spark, root).where("asn is not null").select("peer_ip").distinct()
    return graph.peer_degree(graph.announced_by(base.ann(spark, root)).unionByName(graph.hosted_in(p, own)))


def subjects(spark: SparkSession, root: str) -> DataFrame:
    return typology.subjects(table(spark, root, "clusters"), normalise.sides(base.tx(spark, root)).select("address"))


def typ01_subjects(spark: SparkSession, root: str) -> DataFrame:
    return subjects(spark, root)


def typ02_hits(spark: SparkSession, root: str) -> DataFrame:
    """All four detectors: fan_out, coinjoin_like, peel_chain, structuring."""
    h = typology.hits(typology.sent(base.tx(spark, root), subjects(spark, root)))
    return h.withColumn("txids", F.array_join("txids", ","))


def typ07_entity_types(spark: SparkSession, root: str) -> DataFrame:
    return typology.entity_types(spark).withColumn("basis", F.array_join("basis", ","))


QUERIES = {f.__name__: f for f in (
    grf01_nodes, grf02_flows, grf03_announced_by, grf04_hosted_in, grf05_mixers, grf06_star_edges, grf07_multi_input, grf08_change_claims, grf09_suppressed, grf10_strongest,
    grf11_clusters, grf12_cluster_facts, grf13_peel_hops, grf15_peel_links, grf16_peel_chains, grf18_marked_nodes, grf19_ledger, grf20_snapshot, joi11_neighbourhood,
    org01_peer_degree, typ01_subjects, typ02_hits, typ07_entity_types,
)}

MIXER = "(has_equal_outputs AND n_out >= 3 AND n_in >= 2)"
SHAPED = f"""{base.TX}, shaped AS (SELECT * REPLACE (CASE WHEN output_amounts IS NOT NULL AND len(c) = 1 AND len(output_addresses) >= 2 THEN c[1][3] ELSE -1 END AS change_index)
  FROM (SELECT *, list_filter(list_zip(output_amounts, output_addresses, range(len(output_amounts))), lambda x: x[1] % 1000 <> 0 AND NOT list_contains(input_addresses, x[2])) AS c FROM tx))"""


def _star(rows: str, members: str, evidence: str, confidence: float, name: str) -> str:
    return f"""{name} AS (SELECT txid, first_seen_us, src, dst, {confidence}::DOUBLE AS confidence, '{evidence}' AS evidence FROM (
      SELECT txid, first_seen_us, list_min(m) AS src, unnest(m) AS dst FROM (
        SELECT txid, first_seen_us, list_distinct(list_filter({members}, lambda x: x IS NOT NULL)) AS m FROM shaped WHERE {rows}) WHERE len(m) >= 2) WHERE src <> dst)"""


_INPUTS, _CHANGED = "input_addresses", "list_append(input_addresses, output_addresses[change_index + 1])"
MULTI = _star(f"NOT is_coinbase AND n_in >= 2 AND NOT {MIXER}", _INPUTS, "multi_input", 0.36, "multi")
CHG = _star(f"NOT is_coinbase AND change_index >= 0 AND NOT {MIXER}", _CHANGED, "change_addr", 0.25, "chg")
SUP1 = _star("NOT is_coinbase AND n_out >= 3 AND n_in >= 2", _INPUTS, "multi_input", 0.36, "sup1")
SUP2 = _star("NOT is_coinbase AND n_out >= 3 AND n_in >= 2 AND change_index >= 0", _CHANGED, "change_addr", 0.25, "sup2")
STRONGEST = f"""{base.CLAIMS}, strongest AS (SELECT src, dst, confidence, evidence, ts_us, txid FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, evidence, ts_us NULLS FIRST, txid NULLS FIRST) AS r FROM claims) WHERE r = 1)"""
CLUSTERS = f"""{STRONGEST}, sym AS (SELECT src AS u, dst AS v FROM strongest WHERE confidence >= 0.2 UNION SELECT dst, src FROM strongest WHERE confidence >= 0.2),
  reach(member, r) AS (SELECT DISTINCT u, u FROM sym UNION SELECT reach.member, sym.v FROM reach JOIN sym ON sym.u = reach.r),
  comp AS (SELECT member, min(r) AS root FROM reach GROUP BY member),
  labelled AS (SELECT member, root, 'cluster:' || (dense_rank() OVER (ORDER BY root) - 1) AS cluster_id FROM comp)"""
HOPS = f"""{base.TX}, hops AS (
  SELECT txid, first_seen_us, total_in_sats AS in_sats, list_min(output_amounts) AS peeled_sats,
         output_addresses[list_position(output_amounts, list_max(output_amounts))] AS change_address,
         input_addresses[list_position(list_transform(input_amounts, lambda x: coalesce(x, 0)), list_max(list_transform(input_amounts, lambda x: coalesce(x, 0))))] AS root_address
  FROM tx WHERE NOT is_coinbase AND len(output_addresses) = 2 AND len(output_amounts) = 2 AND NOT {MIXER} AND len(list_filter(output_amounts, lambda x: x IS NULL)) = 0
    AND list_min(output_amounts) < list_max(output_amounts) AND list_sum(output_amounts) > 0 AND list_min(output_amounts) > 0 AND list_min(output_amounts) * 20 <= list_sum(output_amounts) * 7)"""
LINKS = f"""{HOPS}, spender AS (SELECT address, count(DISTINCT txid) AS n, min(txid) AS nxt FROM (SELECT txid, unnest(input_addresses) AS address FROM tx) GROUP BY address),
  l0 AS (SELECT h.*, s.n, s.nxt, g.txid IS NOT NULL AS is_hop FROM hops h LEFT JOIN spender s ON s.address = h.change_address LEFT JOIN hops g ON g.txid = s.nxt),
  l1 AS (SELECT *, CASE WHEN n IS NULL THEN 'no_continuation' WHEN n > 1 THEN 'ambiguous_spend' WHEN NOT is_hop OR nxt = txid THEN 'chain_broken' END AS why FROM l0),
  l2 AS (SELECT *, CASE WHEN why IS NULL THEN nxt END AS nx, count(*) FILTER (why IS NULL) OVER (PARTITION BY CASE WHEN why IS NULL THEN nxt END) AS k FROM l1),
  links AS (SELECT txid, first_seen_us, in_sats, peeled_sats, root_address, CASE WHEN nx IS NOT NULL AND k = 1 THEN nx END AS next, CASE WHEN nx IS NOT NULL AND k > 1 THEN 'chain_broken' ELSE why END AS stop_reason FROM l2)"""
CHAINS = f"""{LINKS}, walk AS (
    SELECT txid AS root, txid, 0 AS pos FROM links WHERE txid NOT IN (SELECT next FROM links WHERE next IS NOT NULL)
    UNION ALL SELECT w.root, l.next, w.pos + 1 FROM walk w JOIN links l USING (txid) WHERE l.next IS NOT NULL),
  chains AS (SELECT root, count(*) AS depth, max(CASE WHEN pos = 0 THEN in_sats END) AS initial_sats, sum(peeled_sats)::BIGINT AS peeled_sats, max(CASE WHEN pos = 0 THEN root_address END) AS root_address,
      min(first_seen_us) AS first_us, max(first_seen_us) AS last_us, arg_max(stop_reason, pos) AS stop_reason, string_agg(w.txid, ',' ORDER BY pos) AS transactions
    FROM walk w JOIN links USING (txid) GROUP BY root)"""
SUBJECTS = """grouped AS (SELECT address, min(cluster_id) AS subject_id FROM (SELECT cluster_id, unnest(addresses) AS address FROM clusters) WHERE address IS NOT NULL GROUP BY address),
  subject_map AS (SELECT subject_id, address FROM grouped UNION ALL
    SELECT 'addr:' || address, address FROM (SELECT DISTINCT address FROM sides) s WHERE address NOT IN (SELECT address FROM grouped))"""
_EDGE = "src, dst, kind, ts_us, sats, confidence, evidence"

HITS = """hsent AS (SELECT DISTINCT subject_id, txid, n_out, total_out_sats, has_equal_outputs, list_min(output_amounts) AS lo
        FROM (SELECT *, unnest(input_addresses) AS address FROM tx WHERE NOT is_coinbase) JOIN subject_map USING (address)),
  h AS (
        SELECT 'fan_out' AS typology, subject_id, string_agg(txid, ',' ORDER BY txid) AS txids, max(n_out)::DOUBLE AS strength, 6.0 AS threshold FROM hsent WHERE n_out >= 6 GROUP BY subject_id
        UNION ALL SELECT 'coinjoin_like', subject_id, string_agg(txid, ',' ORDER BY txid), count(*), 3.0 FROM hsent WHERE has_equal_outputs AND n_out >= 3 GROUP BY subject_id
        UNION ALL SELECT 'peel_chain', subject_id, string_agg(txid, ',' ORDER BY txid), count(*), 0.35 FROM hsent WHERE n_out = 2 AND lo <= 0.35::DOUBLE * total_out_sats GROUP BY subject_id HAVING count(*) >= 2
        UNION ALL SELECT 'structuring', subject_id, string_agg(txid, ',' ORDER BY txid), count(*), 0.15 FROM hsent WHERE n_out = 1 AND total_out_sats IS NOT NULL GROUP BY subject_id
          HAVING count(*) >= 3 AND avg(total_out_sats) > 0 AND stddev_samp(total_out_sats) <= 0.15 * avg(total_out_sats))"""

ORACLES = {
    "grf01_nodes": f"""WITH {base.SIDES}, {base.PEERS},
      ops AS (SELECT asn, min(as_org) AS org, min(first_us) AS f, max(last_us) AS l FROM peers WHERE asn IS NOT NULL GROUP BY asn)
      SELECT 'addr:' || address AS node_id, 'addr' AS kind, CASE WHEN length(address) >= 11 THEN left(address, 6) || '…' || right(address, 4) ELSE address END AS label, min(at_us) AS first_us, max(at_us) AS last_us FROM sides GROUP BY address
      UNION ALL SELECT 'tx:' || txid, 'tx', CASE WHEN length(txid) >= 13 THEN left(txid, 8) || '…' || right(txid, 4) ELSE txid END, first_seen_us, last_seen_us FROM tx
      UNION ALL SELECT 'peer:' || peer_ip, 'peer', CASE WHEN peer_ip LIKE '%:%' THEN split_part(peer_ip, ':', 1) || ':' || split_part(peer_ip, ':', 2) || ':x:x' ELSE split_part(peer_ip, '.', 1) || '.' || split_part(peer_ip, '.', 2) || '.x.x' END, first_us, last_us FROM peers
      UNION ALL SELECT 'asn:' || asn, 'asn', coalesce(org, 'AS' || asn), f, l FROM ops""",
    "grf02_flows": f"""WITH {base.SIDES} SELECT CASE side WHEN 'in' THEN 'addr:' || address ELSE 'tx:' || txid END AS src, CASE side WHEN 'in' THEN 'tx:' || txid ELSE 'addr:' || address END AS dst,
      CASE side WHEN 'in' THEN 'SPENDS' ELSE 'RECEIVES' END AS kind, at_us AS ts_us, sats, 1.0::DOUBLE AS confidence, 'observed' AS evidence FROM sides""",
    "grf03_announced_by": f"""WITH {base.ANN} SELECT 'tx:' || txid AS src, 'peer:' || peer_ip AS dst, 'ANNOUNCED_BY' AS kind, min(seen_us) AS ts_us, NULL::BIGINT AS sats, 1.0::DOUBLE AS confidence, 'observed' AS evidence
      FROM ann WHERE peer_ip IS NOT NULL GROUP BY txid, peer_ip""",
    "grf04_hosted_in": f"""WITH {base.PEERS}, own AS (SELECT DISTINCT peer_ip FROM ann WHERE asn IS NOT NULL)
      SELECT 'peer:' || peer_ip AS src, 'asn:' || asn AS dst, 'HOSTED_IN' AS kind, first_us AS ts_us, NULL::BIGINT AS sats, CASE WHEN o THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence, CASE WHEN o THEN 'observed' ELSE 'geoip' END AS evidence
      FROM (SELECT *, peer_ip IN (SELECT peer_ip FROM own) AS o FROM peers WHERE asn IS NOT NULL)""",
    "grf05_mixers": f"WITH {base.TX} SELECT txid, n_in, n_out, has_equal_outputs, {MIXER} AS is_mixer FROM tx",
    "grf06_star_edges": """SELECT cluster_id, src, dst, 1.0::DOUBLE AS confidence, 'run' AS evidence FROM (SELECT cluster_id, list_min(m) AS src, unnest(m) AS dst FROM (
      SELECT cluster_id, list_distinct(addresses) AS m FROM clusters) WHERE len(m) >= 2) WHERE src <> dst""",
    "grf07_multi_input": f"WITH {SHAPED}, {MULTI} SELECT * FROM multi",
    "grf08_change_claims": f"WITH {SHAPED}, {CHG} SELECT * FROM chg",
    "grf09_suppressed": f"WITH {SHAPED}, {SUP1}, {SUP2} SELECT evidence, count(*) AS n FROM (SELECT * FROM sup1 UNION ALL SELECT * FROM sup2) GROUP BY evidence",
    "grf10_strongest": f"WITH {STRONGEST} SELECT * FROM strongest",
    "grf11_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT * FROM labelled",
    "grf12_cluster_facts": f"""WITH RECURSIVE {CLUSTERS},
      f AS (SELECT cluster_id, min(confidence) AS min_edge_confidence, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS heuristics_used FROM strongest JOIN labelled ON member = src WHERE confidence >= 0.2 GROUP BY cluster_id),
      w AS (SELECT cluster_id, min(evidence) AS weakest_evidence FROM strongest JOIN labelled ON member = src JOIN f USING (cluster_id) WHERE confidence = min_edge_confidence GROUP BY cluster_id)
      SELECT cluster_id, count(*) AS n_addresses, min(member) AS first_address, any_value(min_edge_confidence) AS min_edge_confidence, any_value(weakest_evidence) AS weakest_evidence, any_value(heuristics_used) AS heuristics_used
      FROM labelled JOIN f USING (cluster_id) JOIN w USING (cluster_id) GROUP BY cluster_id""",
    "grf13_peel_hops": f"WITH {HOPS} SELECT * FROM hops",
    "grf15_peel_links": f"WITH {LINKS} SELECT txid, next, stop_reason FROM links",
    "grf16_peel_chains": f"WITH RECURSIVE {CHAINS} SELECT *, round(CASE WHEN initial_sats > 0 THEN peeled_sats::DOUBLE / initial_sats END, 9) AS leak_frac FROM chains",
    "grf18_marked_nodes": f"WITH RECURSIVE {CHAINS} SELECT tx.txid, coalesce({MIXER}, false) AS coinjoin, w.root AS peel_chain_id FROM tx LEFT JOIN walk w ON w.txid = tx.txid",
    "grf19_ledger": f"WITH {SHAPED}, {MULTI}, {CHG} SELECT src, dst, txid, first_seen_us AS available_us, confidence, evidence FROM multi UNION SELECT src, dst, txid, first_seen_us, confidence, evidence FROM chg",
    "grf20_snapshot": f"""WITH {base.CLAIMS} SELECT src, dst, confidence, ts_us AS available_us, txid, evidence FROM (
      SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, ts_us, txid NULLS FIRST, evidence) AS r FROM claims WHERE ts_us <= {CUTOFF_US}) WHERE r = 1""",
    "joi11_neighbourhood": f"""WITH {base.ANN} SELECT 'tx:' || txid AS src, 'peer:' || peer_ip AS dst, 'ANNOUNCED_BY' AS kind, min(seen_us) AS ts_us FROM ann
      WHERE peer_ip IN (SELECT peer_ip FROM ann WHERE geo_country = 'DE') GROUP BY txid, peer_ip""",
    "org01_peer_degree": f"""WITH {base.PEERS} SELECT peer_ip, sum(n)::BIGINT AS peer_degree FROM (
      SELECT peer_ip, count(DISTINCT txid) AS n FROM ann WHERE peer_ip IS NOT NULL GROUP BY peer_ip UNION ALL SELECT peer_ip, 1 FROM peers WHERE asn IS NOT NULL) GROUP BY peer_ip""",
    "typ01_subjects": f"WITH {base.SIDES}, {SUBJECTS} SELECT * FROM subject_map",
    "typ02_hits": f"""WITH {base.SIDES}, {SUBJECTS}, {HITS}
      SELECT left(sha256(typology || ':' || subject_id), 16) AS hit_id, typology, subject_id, txids, strength::DOUBLE AS strength, threshold::DOUBLE AS threshold FROM h""",
    "typ07_entity_types": "SELECT '' AS subject_id, '' AS predicted_type, 0.0 AS confidence, '' AS basis, false AS exempt_from_scoring WHERE false",
}
