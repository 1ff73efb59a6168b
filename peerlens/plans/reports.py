"""Queries of the remaining measures, invariants, alert tables and endpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.functions import text
from peerlens.operators import evaluate, generate, models, normalise, ordered, origin
from peerlens.plans import base, intake, measures, network, problems, scoring
from peerlens.runtime import durable, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


_SCRIPT = "CASE WHEN address LIKE 'bc1p%' THEN 'p2tr' WHEN address LIKE 'bc1q%' AND length(address) = 42 THEN 'p2wpkh' WHEN address LIKE 'bc1q%' AND length(address) = 62 THEN 'p2wsh' WHEN address LIKE '3%' THEN 'p2sh' WHEN address LIKE '1%' THEN 'p2pkh' END"


@query(f"WITH {base.SIDES}, {network.SUBJECTS} SELECT subject_id, count(DISTINCT {_SCRIPT}) + max(({_SCRIPT} IS NULL)::INT) AS n_script_types FROM subject_map WHERE address IN (SELECT address FROM sides) GROUP BY subject_id")
def ftr08_script_types(spark: SparkSession, root: str) -> DataFrame:
    """Distinct address formats among a subject's active members; an unknown format counts as one."""
    active = normalise.sides(base.tx(spark, root)).select("address").distinct()
    kind = text.script_type(F.col("address"))
    return network.subjects(spark, root).join(active, "address", "left_semi").groupBy("subject_id").agg((F.count_distinct(kind) + F.max(kind.isNull().cast("int"))).cast("long").alias("n_script_types"))


ORIGIN_FEATURES = [
    "delta_first_us", "rank_in_tx", "n_announcements", "n_observers_seen", "n_observers_blind", "peer_frac_rank_one", "peer_n_txids", "peer_degree", "announce_spread_us",
    "payer_shared", "n_candidates", "net_class_code", "is_tor_exit", "is_hosting", "mle_logscore",
]


@query()
def org09_trained_ensemble(spark: SparkSession, root: str) -> DataFrame:
    """All candidates of the table by an ensemble that was trained and calibrated on a labelled world.

    The world is generated here, as the tables carry no truth for their own announcements: the trees
    see its first three quarters by time, the Platt line the last one.
    """
    world = durable(generate.announcements(spark, 150, peers=40, observers=4), "world")
    ann = normalise.announcements(generate.as_sealed(world))
    none = spark.createDataFrame([], "peer_ip string, v_asn int, v_as_org string, v_net_class string, v_geo_country string")
    known = origin.with_likelihood(origin.candidates(ann, normalise.peers(ann, none)), ann, 2_000_000.0)
    truth = world.select("txid", "true_peer").distinct()
    rows = durable(known.join(truth, "txid").withColumn("y", F.col("peer_ip") == F.col("true_peer")), "labelled-candidates")
    parts = durable(evaluate.split_by_time(rows, ["seen_us", "row_id"], 0.75), "ensemble-parts")
    model = models.train_trees(parts.where("part = 'train'"), ORIGIN_FEATURES, "y", trees=10, depth=3)
    model = models.with_platt(model, parts.where("part = 'rest'"), "y")
    # the windows of the ending must not evaluate the trees again
    scored = durable(models.with_risk(scoring.candidates(spark, root), model, "p_origin"), "ensemble-scores")
    out = origin.finalise(scored, "ensemble")
    return out.select("txid", "peer_ip", F.round("p_origin", 6).alias("p_origin"), "rank", "abstain", "abstain_reason")


@query()
def gen06_flooded_world(spark: SparkSession, root: str) -> DataFrame:
    return generate.announcements(spark, 50, peers=30, observers=3)


@query(f"""WITH {scoring.CAND}, {scoring.FIRST}, truth AS (SELECT txid, arg_min(peer_ip, row_id) AS peer, arg_min(asn, row_id) FILTER (asn IS NOT NULL) AS asn, arg_min(geo_country, row_id) FILTER (geo_country IS NOT NULL) AS country FROM origin_abstain WHERE peer_ip IS NOT NULL GROUP BY txid),
    lab AS (SELECT e.txid, e.peer_ip, e.p_origin, p.asn, p.geo_country FROM est e LEFT JOIN peers p USING (peer_ip)),
    h AS (SELECT txid, arg_max(peer_ip, (p_origin, peer_ip)) AS v FROM lab GROUP BY txid),
    a AS (SELECT txid, arg_max(asn, (m, asn)) AS v FROM (SELECT txid, asn, sum(floor(p_origin * 1e9)::BIGINT) AS m FROM lab WHERE asn IS NOT NULL GROUP BY ALL) GROUP BY txid),
    c AS (SELECT txid, arg_max(geo_country, (m, geo_country)) AS v FROM (SELECT txid, geo_country, sum(floor(p_origin * 1e9)::BIGINT) AS m FROM lab WHERE geo_country IS NOT NULL GROUP BY ALL) GROUP BY txid)
    SELECT 'host' AS grain, count(*) AS n, count(h.v) AS covered, count(*) FILTER (h.v = peer) AS top1 FROM truth LEFT JOIN h USING (txid)
    UNION ALL SELECT 'operator', count(*), count(a.v), count(*) FILTER (a.v = asn) FROM truth LEFT JOIN a USING (txid) UNION ALL SELECT 'region', count(*), count(c.v), count(*) FILTER (c.v = country) FROM truth LEFT JOIN c USING (txid)""")
def evl05_granularities(spark: SparkSession, root: str) -> DataFrame:
    """Top-1 at host, operator and region grain over all transactions of a truth table."""
    t = table(spark, root, "origin_abstain").where("peer_ip is not null")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_id")))
    truth = t.groupBy("txid").agg(F.min_by("peer_ip", "row_id").alias("peer"), first("asn").alias("asn"), first("geo_country").alias("country"))
    est = origin.first_spy(scoring.candidates(spark, root)).select("txid", "peer_ip", "p_origin").join(base.peers(spark, root).select("peer_ip", "asn", "geo_country"), "peer_ip", "left")

    def grain(name: str, key: str, want: str) -> DataFrame:
        mass = est.where(F.col(key).isNotNull()).groupBy("txid", F.col(key).alias("k")).agg(F.max("p_origin").alias("m") if name == "host" else F.sum(F.floor(F.col("p_origin") * 1e9)).alias("m"))
        best = mass.groupBy("txid").agg(F.max_by("k", F.struct("m", "k")).alias("v"))
        return truth.join(best, "txid", "left").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("covered"), F.count_if(F.col("v") == F.col(want)).alias("top1")).select(F.lit(name).alias("grain"), "n", "covered", "top1")

    return reduce(DataFrame.unionByName, [grain("host", "peer_ip", "peer"), grain("operator", "asn", "asn"), grain("region", "geo_country", "country")])


@query(f"""WITH {base.SIDES}, {network.SUBJECTS} SELECT subject_id, (sum(sats) FILTER (side = 'out'))::BIGINT AS received FROM sides JOIN subject_map USING (address) GROUP BY subject_id ORDER BY received DESC NULLS LAST, subject_id LIMIT 20""")
def evl08_baseline(spark: SparkSession, root: str) -> DataFrame:
    """The trivial rule: subjects by what they received."""
    s = normalise.sides(base.tx(spark, root)).join(network.subjects(spark, root), "address")
    return s.groupBy("subject_id").agg(F.sum(F.when(F.col("side") == "out", F.col("sats"))).alias("received")).orderBy(F.col("received").desc_nulls_last(), "subject_id").limit(20)


@query(f"""WITH {base.TX} SELECT 'duplicate_txid' AS rule, (SELECT count(*) FROM (SELECT txid FROM tx GROUP BY txid HAVING count(*) > 1)) AS n
    UNION ALL SELECT 'length_mismatch', count(*) FROM tx WHERE len(output_addresses) <> n_out OR len(input_addresses) <> n_in
    UNION ALL SELECT 'value_not_conserved', count(*) FROM tx WHERE NOT is_coinbase AND total_in_sats < total_out_sats
    UNION ALL SELECT 'negative_fee', count(*) FROM tx WHERE fee_sats < 0
    UNION ALL SELECT 'seen_backwards', count(*) FROM tx WHERE last_seen_us < first_seen_us
    UNION ALL SELECT 'coinbase_with_inputs', count(*) FROM tx WHERE is_coinbase AND n_in > 0
    UNION ALL SELECT 'claim_to_itself', count(*) FROM edges WHERE a = b
    UNION ALL SELECT 'confidence_out_of_range', count(*) FROM edges WHERE confidence < 0 OR confidence > 1
    UNION ALL SELECT 'cluster_size', count(*) FROM clusters WHERE len(addresses) <> n_addresses
    UNION ALL SELECT 'probability_out_of_range', count(*) FROM origin_estimates WHERE NOT isnan(p_origin) AND (p_origin < 0 OR p_origin > 1)""")
def evl09_invariants(spark: SparkSession, root: str) -> DataFrame:
    """(rule, n): violations of each invariant of the tables, as one rule table."""
    t, e, c, o = base.tx(spark, root), table(spark, root, "edges"), table(spark, root, "clusters"), table(spark, root, "origin_estimates")
    rule = lambda df, name, cond: df.agg(F.count_if(cond).alias("n")).select(F.lit(name).alias("rule"), "n")
    col = F.col
    return reduce(DataFrame.unionByName, [
        rule(t.groupBy("txid").agg(F.count(F.lit(1)).alias("k")), "duplicate_txid", col("k") > 1),
        rule(t, "length_mismatch", (F.size("output_addresses") != col("n_out")) | (F.size("input_addresses") != col("n_in"))),
        rule(t, "value_not_conserved", ~col("is_coinbase") & (col("total_in_sats") < col("total_out_sats"))),
        rule(t, "negative_fee", col("fee_sats") < 0), rule(t, "seen_backwards", col("last_seen_us") < col("first_seen_us")), rule(t, "coinbase_with_inputs", col("is_coinbase") & (col("n_in") > 0)),
        rule(e, "claim_to_itself", col("a") == col("b")), rule(e, "confidence_out_of_range", (col("confidence") < 0) | (col("confidence") > 1)), rule(c, "cluster_size", F.size("addresses") != col("n_addresses")),
        rule(o, "probability_out_of_range", ~F.isnan("p_origin") & ((col("p_origin") < 0) | (col("p_origin") > 1))),
    ])


@query(f"""WITH {base.ANN}, {base.TX}, {scoring.PAYER}, c AS (SELECT txid, peer_ip, min(seen_us) AS s, min(row_id) AS row_id FROM ann GROUP BY ALL)
    SELECT txid, max(peer_ip) FILTER (a = 1) AS first_seen_peer, max(peer_ip) FILTER (b = 1) AS payer_linked_peer FROM (
      SELECT c.txid, c.peer_ip, row_number() OVER (PARTITION BY c.txid ORDER BY s, c.row_id) AS a, row_number() OVER (PARTITION BY c.txid ORDER BY coalesce(payer_shared, 0) DESC, s, c.row_id) AS b
      FROM c LEFT JOIN links l ON l.txid = c.txid AND l.peer_ip = c.peer_ip) GROUP BY txid""")
def evl13_trivial_rules(spark: SparkSession, root: str) -> DataFrame:
    """The peer that each trivial rule names: first seen, and payer linkage."""
    a = base.ann(spark, root)
    c = a.groupBy("txid", "peer_ip").agg(F.min("seen_us").alias("s"), F.min("row_id").alias("row_id")).join(origin.payer_links(a, base.tx(spark, root)), ["txid", "peer_ip"], "left")
    return c.groupBy("txid").agg(F.min_by("peer_ip", F.struct("s", "row_id")).alias("first_seen_peer"), F.min_by("peer_ip", F.struct((-F.coalesce("payer_shared", F.lit(0))).alias("k"), "s", "row_id")).alias("payer_linked_peer"))


@query(f"""WITH {base.TX} SELECT s.txid, count(*) AS n, min(s.ts_us - t.first_seen_us) AS least_delay_us, arg_min(s.row_id, (s.ts_us - t.first_seen_us, s.row_id)) AS least_row FROM sealed s JOIN tx t USING (txid) WHERE s.ts_us IS NOT NULL AND t.first_seen_us IS NOT NULL GROUP BY s.txid""")
def evl17_delays(spark: SparkSession, root: str) -> DataFrame:
    """Delay of announcements behind a transaction's recorded first sight, with the row that shows the least."""
    s = table(spark, root, "sealed").where("ts_us is not null").select("row_id", "txid", "ts_us")
    j = s.join(base.tx(spark, root).where("first_seen_us is not null").select("txid", "first_seen_us"), "txid").withColumn("delay", F.col("ts_us") - F.col("first_seen_us"))
    return j.groupBy("txid").agg(F.count(F.lit(1)).alias("n"), F.min("delay").alias("least_delay_us"), F.min_by("row_id", F.struct("delay", "row_id")).alias("least_row"))


@query(f"""WITH {measures._SCORED}, p AS (SELECT id, y, (score + 1) / 2 AS q FROM scored), s AS (SELECT y, CASE WHEN y THEN 1 - q ELSE q END AS s FROM p WHERE y IS NOT NULL AND q IS NOT NULL),
    r AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS i, count(*) OVER (PARTITION BY y) AS n FROM s), k AS (SELECT max(s) FILTER (NOT y) AS q0, max(s) FILTER (y) AS q1 FROM r WHERE i = ceil((n + 1) * 0.9)),
    w AS (SELECT id, q, q <= q0 AS in0, 1 - q <= q1 AS in1 FROM p, k)
    SELECT id, row_number() OVER (ORDER BY q DESC, id) AS rank, round(q, 9) AS risk, CASE WHEN q > 0.65 THEN 'high' WHEN q > 0.40 THEN 'medium' ELSE 'low' END AS severity FROM w WHERE NOT (in0 AND NOT in1)""")
def alr01_ranked(spark: SparkSession, root: str) -> DataFrame:
    """Every scored row whose set does not clear it, ranked by risk in a total order and banded."""
    kept = measures._calibrated(spark, root).where("label <> 'LIKELY_LICIT'").select("id", F.col("q").alias("risk"), F.lit(1).cast("long").alias("one"))
    ranked = ordered.running_total(kept, [], [F.col("risk").desc(), F.col("id").asc()], "one", "rank")
    return ranked.select("id", "rank", F.round("risk", 9).alias("risk"), F.when(F.col("risk") > 0.65, "high").when(F.col("risk") > 0.40, "medium").otherwise("low").alias("severity"))


@query("""WITH s AS (SELECT peer_ip, count(DISTINCT subject) AS n FROM (SELECT peer_ip, txid AS subject FROM origin_abstain WHERE peer_ip IS NOT NULL) GROUP BY peer_ip)
    SELECT cluster_id AS id, 'weak_cluster_link' AS kind, round(1 - min_edge_confidence, 4) AS strength FROM clusters WHERE min_edge_confidence < 0.5
    UNION ALL SELECT peer_ip, 'shared_ip', round(1 - 1.0 / n, 4) FROM s WHERE n > 1
    UNION ALL SELECT txid, 'insufficient_observation', round(1 - m / 1e6, 4) FROM (SELECT txid, sum(floor(p_origin * 1e6 + 0.5)::BIGINT) AS m FROM (SELECT DISTINCT txid, peer_ip, p_origin FROM origin_estimates WHERE estimator = 'ensemble' AND NOT isnan(p_origin)) GROUP BY txid) WHERE m < 1000000""")
def alr04_counter_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Doubts as rows: weak links, shared addresses, probability that no observed peer accounts for."""
    weak = table(spark, root, "clusters").where("min_edge_confidence < 0.5").select(F.col("cluster_id").alias("id"), F.lit("weak_cluster_link").alias("kind"), F.round(1 - F.col("min_edge_confidence"), 4).alias("strength"))
    shared = table(spark, root, "origin_abstain").where("peer_ip is not null").groupBy("peer_ip").agg(F.count_distinct("txid").alias("n")).where("n > 1")
    e = table(spark, root, "origin_estimates").where((F.col("estimator") == "ensemble") & ~F.isnan("p_origin") & F.col("p_origin").isNotNull()).select("txid", "peer_ip", "p_origin").distinct()
    mass = e.groupBy("txid").agg(F.sum(F.floor(F.col("p_origin") * 1e6 + 0.5)).alias("m")).where("m < 1000000")
    return weak.unionByName(shared.select(F.col("peer_ip").alias("id"), F.lit("shared_ip").alias("kind"), F.round(1 - 1 / F.col("n"), 4).alias("strength"))).unionByName(
        mass.select(F.col("txid").alias("id"), F.lit("insufficient_observation").alias("kind"), F.round(1 - F.col("m") / 1e6, 4).alias("strength"))
    )


@query("""SELECT 'peer ' || CASE WHEN peer_ip LIKE '%:%' THEN split_part(peer_ip, ':', 1) || ':' || split_part(peer_ip, ':', 2) || ':x:x' ELSE split_part(peer_ip, '.', 1) || '.' || split_part(peer_ip, '.', 2) || '.x.x' END || ' first of ' || n || ' peers' AS line, txid
    FROM (SELECT txid, arg_min(src_ip, (ts_us, row_id)) AS peer_ip, count(DISTINCT src_ip) AS n FROM sealed WHERE ts_us IS NOT NULL GROUP BY txid)""")
def alr03_evidence_lines(spark: SparkSession, root: str) -> DataFrame:
    """One redacted line of network evidence per transaction."""
    s = table(spark, root, "sealed").where("ts_us is not null").groupBy("txid").agg(F.min_by("src_ip", F.struct("ts_us", "row_id")).alias("peer_ip"), F.count_distinct("src_ip").alias("n"))
    return s.select(F.concat(F.lit("peer "), text.ip_label(F.col("peer_ip")), F.lit(" first of "), F.col("n").cast("string"), F.lit(" peers")).alias("line"), "txid")


@query(f"""WITH {base.CLAIMS}, top AS (SELECT cluster_id, n_addresses, unnest(addresses) AS address FROM (SELECT * FROM clusters ORDER BY n_addresses DESC, cluster_id LIMIT 1))
    SELECT src, dst, max(confidence) AS confidence FROM claims WHERE src IN (SELECT address FROM top) OR dst IN (SELECT address FROM top) GROUP BY src, dst""")
def api07_actor_hop(spark: SparkSession, root: str) -> DataFrame:
    """One hop of ownership claims around the largest cluster."""
    focus = table(spark, root, "clusters").orderBy(F.desc("n_addresses"), "cluster_id").limit(1).select(F.explode("addresses").alias("node_id"))
    from peerlens.operators.graph import neighbourhood

    e = base.claims(spark, root).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    return neighbourhood(e, focus)


@query("""SELECT cluster_id, n_addresses::BIGINT AS n_addresses, min_edge_confidence FROM clusters WHERE min_edge_confidence < 0.3 ORDER BY n_addresses DESC, cluster_id LIMIT 50 OFFSET 10""")
def api08_alert_page(spark: SparkSession, root: str) -> DataFrame:
    """A filtered page in a total order."""
    page = table(spark, root, "clusters").where("min_edge_confidence < 0.3").orderBy(F.desc("n_addresses"), "cluster_id").offset(10).limit(50)
    return page.select("cluster_id", F.col("n_addresses").cast("long").alias("n_addresses"), "min_edge_confidence")


@query(f"""WITH a AS ({intake.ORACLES["val10_13_accounting"]}), c AS ({intake.ORACLES["val11_src08_mapped_columns"]}), t AS (SELECT sum(n)::BIGINT AS n_read, coalesce(sum(n) FILTER (reject_reason IS NULL), 0)::BIGINT AS n_loaded, coalesce(sum(n) FILTER (reject_reason IS NOT NULL), 0)::BIGINT AS n_rejected FROM a)
    SELECT 'rows' AS section, 'read' AS name, n_read AS n FROM t UNION ALL SELECT 'rows', 'loaded', n_loaded FROM t UNION ALL SELECT 'rows', 'rejected', n_rejected FROM t
    UNION ALL SELECT 'check', 'adds_up', (n_read = n_loaded + n_rejected)::INT FROM t UNION ALL SELECT 'reason', reject_reason, n FROM a WHERE reject_reason IS NOT NULL
    UNION ALL SELECT 'mapped', column_name, n_files FROM c
    UNION ALL SELECT 'reject', line_id::VARCHAR, rn FROM (SELECT line_id, row_number() OVER (ORDER BY line_id) AS rn FROM ({problems.ORACLES["p7_found"]})) WHERE rn <= 200""")
def api01_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(section, name, n): row counts and whether they add up, reasons, files that map each column, the first two hundred rejects."""
    a = durable(intake.val10_13_accounting(spark, root), "accounting")
    t = a.agg(F.sum("n").alias("n_read"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.col("n"))), F.lit(0)).alias("n_loaded"), F.coalesce(F.sum(F.when(F.col("reject_reason").isNotNull(), F.col("n"))), F.lit(0)).alias("n_rejected"))
    row = lambda df, section, name, n: df.select(F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("n"))
    first = problems.p7_found(spark, root).orderBy("line_id").limit(200).select("line_id")
    w = Window.orderBy("line_id")  # over the two hundred rows
    return reduce(DataFrame.unionByName, [
        *[row(t, "rows", F.lit(k), F.col(f"n_{k}")) for k in ("read", "loaded", "rejected")],
        row(t, "check", F.lit("adds_up"), F.col("n_read") == F.col("n_loaded") + F.col("n_rejected")),
        row(a.where("reject_reason is not null"), "reason", F.col("reject_reason"), F.col("n")),
        row(intake.val11_src08_mapped_columns(spark, root), "mapped", F.col("column_name"), F.col("n_files")),
        row(first.withColumn("n", F.row_number().over(w)), "reject", F.col("line_id").cast("string"), F.col("n")),
    ])


@query("""WITH b AS (SELECT block_height, count(*) AS n FROM sealed WHERE block_height IS NOT NULL GROUP BY block_height), i AS (SELECT *, row_number() OVER (ORDER BY block_height) - 1 AS pos, count(*) OVER () AS k FROM b)
    SELECT block_height::BIGINT AS block_height, n FROM i WHERE pos % ((k + 1999) // 2000) = 0""")
def api02_block_series(spark: SparkSession, root: str) -> DataFrame:
    """Announcements by block, thinned evenly to at most two thousand points."""
    series = durable(table(spark, root, "sealed").where("block_height is not null").groupBy("block_height").agg(F.count(F.lit(1)).alias("n")), "series")
    step = max(1, -(-series.count() // 2_000))
    placed = ordered.running_total(series.withColumn("one", F.lit(1).cast("long")), [], [F.col("block_height").asc()], "one", "upto")
    return placed.where((F.col("upto") - 1) % step == 0).select(F.col("block_height").cast("long").alias("block_height"), "n")


@query(f"""WITH {scoring.CAND}, {scoring.FIRST}, f AS (SELECT min(txid) AS txid FROM ann WHERE rank_in_tx > 1), l AS (SELECT a.txid, peer_ip, min(seen_us) AS first_us, count(*) AS n FROM ann a JOIN f USING (txid) GROUP BY ALL)
    SELECT l.txid, l.peer_ip, first_us - min(first_us) OVER () AS offset_us, n, round(p_origin, 6) + 0.0 AS p_origin, row_number() OVER (ORDER BY p_origin DESC, l.peer_ip) = 1 AS leads, abstain FROM l JOIN est e ON e.txid = l.txid AND e.peer_ip = l.peer_ip""")
def api04_origin(spark: SparkSession, root: str, txid: str | None = None) -> DataFrame:
    """The lanes of one transaction (default: the first with two ranks) with their offset and probability, and which of them leads."""
    a = base.ann(spark, root)
    txid = txid or a.where("rank_in_tx > 1").agg(F.min("txid")).first()[0]
    lanes = a.where(F.col("txid") == F.lit(txid)).groupBy("txid", "peer_ip").agg(F.min("seen_us").alias("first_us"), F.count(F.lit(1)).alias("n"))
    est = origin.first_spy(scoring.candidates(spark, root)).where(F.col("txid") == F.lit(txid)).select("txid", "peer_ip", "p_origin", "abstain")
    one = Window.partitionBy("txid")
    return lanes.join(est, ["txid", "peer_ip"]).select(
        "txid", "peer_ip", (F.col("first_us") - F.min("first_us").over(one)).alias("offset_us"), "n", F.round("p_origin", 6).alias("p_origin"), (F.row_number().over(one.orderBy(F.desc("p_origin"), "peer_ip")) == 1).alias("leads"), "abstain")


@query("""SELECT feed, encoding, count(*) AS n_files, min(arrived_us) AS first_us, max(arrived_us) AS last_us, count(DISTINCT array_to_string(headers, ',')) AS n_headers FROM capture_files GROUP BY feed, encoding""")
def api01_custody(spark: SparkSession, root: str) -> DataFrame:
    """Custody of the capture files by feed and encoding."""
    f = table(spark, root, "capture_files")
    return f.groupBy("feed", "encoding").agg(F.count(F.lit(1)).alias("n_files"), F.min("arrived_us").alias("first_us"), F.max("arrived_us").alias("last_us"), F.count_distinct(F.array_join("headers", ",")).alias("n_headers"))
