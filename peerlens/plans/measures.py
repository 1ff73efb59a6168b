"""Queries of the measures, scores, alerts and read endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.operators import evaluate
from peerlens.plans import base, network, scoring
from peerlens.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# Labelled scores: the latent first coordinate of an embedding against its label's parity.
def scored(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 2).alias("score"), (F.col("label") % 2 == 0).alias("y"))


_SCORED = "scored AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 2) AS score, label % 2 = 0 AS y FROM embeddings)"


@query(f"""WITH {_SCORED}, s AS (SELECT score, sum(y::INT) AS pos, sum((NOT y)::INT) AS neg FROM scored GROUP BY score),
    c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM s),
    r AS (SELECT sum(neg * (cp - pos) + 0.5 * neg * pos) / (sum(pos) * sum(neg)) AS roc, sum(pos) AS n_pos, sum(neg) AS n_neg FROM c),
    p AS (SELECT sum((cp - pos + i) / (cp - pos + i + cn)::DOUBLE) AS prec FROM (SELECT *, unnest(range(1, pos::BIGINT + 1)) AS i FROM c WHERE pos > 0))
    SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(roc, 9) AS roc_auc, round(prec / n_pos, 9) AS pr_auc FROM r, p""")
def evl06_curve_areas(spark: SparkSession, root: str) -> DataFrame:
    r = evaluate.curve_areas(scored(spark, root), "score", "y")
    return r.withColumns({c: F.round(c, 9) for c in ("roc_auc", "pr_auc")})


@query(f"WITH {_SCORED}, t AS (SELECT y FROM scored ORDER BY score DESC, id LIMIT 20) SELECT round((SELECT avg(y::INT) FROM t), 9) AS precision_at_k, round((SELECT sum(y::INT) FROM t)::DOUBLE / (SELECT sum(y::INT) FROM scored), 9) AS recall_at_k")
def evl07_at_k(spark: SparkSession, root: str) -> DataFrame:
    r = evaluate.at_k(scored(spark, root), "score", "y", "id", 20)
    return r.withColumns({c: F.round(c, 9) for c in r.columns})


@query("""WITH p AS (SELECT DISTINCT address AS member, cluster_id AS gp FROM (SELECT cluster_id, unnest(addresses) AS address FROM clusters)), t AS (SELECT DISTINCT address AS member, subject_id AS gt FROM members WHERE subject_id IS NOT NULL),
    b AS (SELECT * FROM p JOIN t USING (member)),
    x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM b GROUP BY gp)) AS ip, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM b GROUP BY gt)) AS it, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM b GROUP BY gp, gt)) AS ib)
    SELECT round(CASE WHEN ip > 0 THEN ib / ip END, 9) AS precision, round(CASE WHEN it > 0 THEN ib / it END, 9) AS recall, round(CASE WHEN ip > 0 AND it > 0 AND ib > 0 THEN 2 * (ib / ip) * (ib / it) / (ib / ip + ib / it) END, 9) AS f1 FROM x""")
def evl03_pair_quality(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "clusters").select("cluster_id", F.explode("addresses").alias("member"))
    t = table(spark, root, "members").where("subject_id is not null").select("subject_id", F.col("address").alias("member"))
    r = evaluate.pair_quality(p, t, "member", "cluster_id", "subject_id")
    return r.withColumns({c: F.round(c, 9) for c in r.columns})


@query(f"""WITH {scoring.CAND}, {scoring.FIRST}, truth AS (SELECT txid, arg_min(peer_ip, row_id) AS true_peer FROM origin_abstain WHERE peer_ip IS NOT NULL GROUP BY txid)
    SELECT count(*) AS n_tx, count(e.txid) AS n_covered, count(*) FILTER (r1 = true_peer) AS top1, count(*) FILTER (in3) AS top3 FROM truth t LEFT JOIN (
      SELECT est.txid, max(peer_ip) FILTER (rk = 1) AS r1, bool_or(rk <= 3 AND peer_ip = true_peer) AS in3 FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY rank) AS rk FROM est) est JOIN truth USING (txid) GROUP BY est.txid) e USING (txid)""")
def evl04_origin_score(spark: SparkSession, root: str) -> DataFrame:
    """Top-1 and top-3 over all transactions of a truth table, covered or not."""
    truth = table(spark, root, "origin_abstain").where("peer_ip is not null").groupBy("txid").agg(F.min_by("peer_ip", "row_id").alias("true_peer"))
    from peerlens.operators import origin

    est = origin.first_spy(scoring.candidates(spark, root)).withColumn("rk", F.row_number().over(Window.partitionBy("txid").orderBy("rank")))
    per = est.join(truth, "txid").groupBy("txid").agg(F.max(F.when(F.col("rk") == 1, F.col("peer_ip"))).alias("r1"), F.bool_or((F.col("rk") <= 3) & (F.col("peer_ip") == F.col("true_peer"))).alias("in3"))
    j = truth.join(per, "txid", "left")
    return j.agg(F.count(F.lit(1)).alias("n_tx"), F.count("r1").alias("n_covered"), F.count_if(F.col("r1") == F.col("true_peer")).alias("top1"), F.count_if("in3").alias("top3"))


@query(f"""WITH {base.TX}, s AS (SELECT min(first_seen_us) AS lo, max(first_seen_us) AS hi FROM tx), b AS (SELECT lo + floor((hi - lo) * 0.7)::BIGINT AS boundary_us FROM s)
    SELECT boundary_us, count(*) FILTER (first_seen_us < boundary_us) AS n_train, count(*) FILTER (first_seen_us >= boundary_us) AS n_holdout FROM tx, b GROUP BY boundary_us""")
def evl01_time_boundary(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root)
    lo, hi = t.agg(F.min("first_seen_us"), F.max("first_seen_us")).first()
    cut = evaluate.time_boundary(lo or 0, hi or 0, 0.7)
    return t.agg(F.lit(cut).cast("long").alias("boundary_us"), F.count_if(F.col("first_seen_us") < cut).alias("n_train"), F.count_if(F.col("first_seen_us") >= cut).alias("n_holdout"))


@query(f"WITH {_SCORED}, p AS (SELECT *, (score + 1) / 2 AS q FROM scored) SELECT round(avg((q - y::INT) * (q - y::INT)), 9) AS brier, round(2 * count(*) FILTER (q >= 0.5 AND y)::DOUBLE / nullif(2 * count(*) FILTER (q >= 0.5 AND y) + count(*) FILTER (q >= 0.5 AND NOT y) + count(*) FILTER (q < 0.5 AND y), 0), 9) AS f1_at_half FROM p")
def evl10_brier(spark: SparkSession, root: str) -> DataFrame:
    r = evaluate.brier(scored(spark, root).withColumn("q", (F.col("score") + 1) / 2), "q", "y")
    return r.withColumns({c: F.round(c, 9) for c in r.columns})


@query("SELECT rule, 0::BIGINT AS n FROM (VALUES ('mass_above_one'), ('rank_gap'), ('wrong_first_rank'), ('margin_differs')) v(rule)")
def evl18_estimate_contract(spark: SparkSession, root: str) -> DataFrame:
    """Our own estimates break no rule of their contract."""
    from peerlens.operators import origin

    return evaluate.estimate_violations(origin.timing_mle(scoring.candidates(spark, root)))


@query("SELECT 'a' AS side, peer_ip FROM (SELECT peer_ip FROM origin_abstain EXCEPT ALL SELECT peer_ip FROM origin_estimates) UNION ALL SELECT 'b', peer_ip FROM (SELECT peer_ip FROM origin_estimates EXCEPT ALL SELECT peer_ip FROM origin_abstain)")
def evl19_table_diff(spark: SparkSession, root: str) -> DataFrame:
    from peerlens.sources.sinks import differing_rows

    return differing_rows(table(spark, root, "origin_abstain").select("peer_ip"), table(spark, root, "origin_estimates").select("peer_ip"))


def _calibrated(spark: SparkSession, root: str) -> DataFrame:
    """All scored rows with sets; ``is_calibration`` marks the rows that the quantiles come from, which is every labelled one with a score."""
    p = scored(spark, root).withColumn("q", (F.col("score") + 1) / 2).withColumn("is_calibration", F.col("y").isNotNull() & F.col("q").isNotNull())
    return evaluate.conformal_sets(p, "q", evaluate.conformal_quantiles(p.where("is_calibration"), "q", "y"))


@query(f"""WITH {_SCORED}, p AS (SELECT id, y, (score + 1) / 2 AS q FROM scored), s AS (SELECT y, CASE WHEN y THEN 1 - q ELSE q END AS s FROM p WHERE y IS NOT NULL AND q IS NOT NULL),
    r AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS i, count(*) OVER (PARTITION BY y) AS n FROM s), k AS (SELECT max(s) FILTER (NOT y) AS q0, max(s) FILTER (y) AS q1 FROM r WHERE i = ceil((n + 1) * 0.9)),
    w AS (SELECT id, y IS NOT NULL AND q IS NOT NULL AS is_calibration, q, q <= q0 AS in0, 1 - q <= q1 AS in1 FROM p, k)
    SELECT id, is_calibration, CASE WHEN in0 AND in1 THEN 'UNCLEAR' WHEN in1 THEN 'LIKELY_ILLICIT' WHEN in0 THEN 'LIKELY_LICIT' ELSE 'ABSTAIN' END AS label, CASE WHEN in0 AND in1 THEN 0.0 ELSE round(greatest(q * 0.85, 0), 6) END::DOUBLE AS conf_low, CASE WHEN in0 AND in1 THEN 1.0 ELSE round(least(q * 1.15, 1.0), 6) END::DOUBLE AS conf_high FROM w""")
def mdl02_all_sets(spark: SparkSession, root: str) -> DataFrame:
    """MDL-02, 04 and 05: a class-conditional set, its label and the display band for every row."""
    return _calibrated(spark, root).select("id", "is_calibration", "label", F.round("conf_low", 6).alias("conf_low"), F.round("conf_high", 6).alias("conf_high"))


@query(f"""WITH {_SCORED}, s AS (SELECT y::INT AS truth, CASE WHEN y THEN 1 - (score + 1) / 2 ELSE (score + 1) / 2 END AS s, (score + 1) / 2 AS q FROM scored WHERE y IS NOT NULL AND score IS NOT NULL),
    r AS (SELECT truth, s, row_number() OVER (PARTITION BY truth ORDER BY s) AS i, count(*) OVER (PARTITION BY truth) AS n FROM s), k AS (SELECT truth, max(s) AS top FROM r WHERE i = ceil((n + 1) * 0.9) GROUP BY truth)
    SELECT truth, count(*) AS n, round(avg((s <= top)::INT), 9) AS coverage FROM s JOIN k USING (truth) GROUP BY truth""")
def mdl06_coverage(spark: SparkSession, root: str) -> DataFrame:
    return evaluate.coverage(_calibrated(spark, root).where("is_calibration"), "y").select(F.col("truth").cast("long").alias("truth"), "n", F.round("coverage", 9).alias("coverage"))


# Risk of a subject here: the share of its sends that were refused an origin, plus its typologies.
@query(f"""WITH n AS (SELECT txid, count(*) AS announcements FROM sealed WHERE ts_us IS NOT NULL AND txid IS NOT NULL GROUP BY txid), {base.TX}
    SELECT announcements AS k, count(*) AS n_tx FROM tx JOIN n USING (txid) WHERE NOT is_coinbase GROUP BY announcements""")
def api02_collapse(spark: SparkSession, root: str) -> DataFrame:
    per_tx = table(spark, root, "sealed").where("ts_us is not null and txid is not null").groupBy("txid").agg(F.count(F.lit(1)).alias("k"))
    return base.tx(spark, root).where("not is_coinbase").join(per_tx, "txid").groupBy("k").agg(F.count(F.lit(1)).alias("n_tx"))


@query(f"""WITH {base.TX}, a AS (SELECT txid, bool_or(abstain) AS abstained FROM origin_estimates WHERE estimator = 'ensemble' GROUP BY txid)
    SELECT txid, first_seen_us, n_in::BIGINT AS n_in, n_out::BIGINT AS n_out, coalesce(abstained, false) AS abstained FROM tx LEFT JOIN a USING (txid) ORDER BY txid LIMIT 200 OFFSET 100""")
def api03_transactions(spark: SparkSession, root: str) -> DataFrame:
    """A page of transactions in txid order with the refusal flag."""
    a = table(spark, root, "origin_estimates").where("estimator = 'ensemble'").groupBy("txid").agg(F.bool_or("abstain").alias("abstained"))
    page = base.tx(spark, root).select("txid", "first_seen_us", "n_in", "n_out").orderBy("txid").offset(100).limit(200)
    return page.join(a, "txid", "left").select("txid", "first_seen_us", F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"), F.coalesce("abstained", F.lit(False)).alias("abstained"))


@query(f"""WITH {base.ANN}, f AS (SELECT min(txid) AS txid FROM ann WHERE rank_in_tx > 1), l AS (SELECT a.txid, peer_ip, min(seen_us) AS first_us, count(*) AS n FROM ann a JOIN f USING (txid) GROUP BY ALL)
    SELECT txid, peer_ip, first_us - min(first_us) OVER () AS offset_us, n FROM l""")
def api04_origin_lanes(spark: SparkSession, root: str) -> DataFrame:
    """The lanes of one transaction: each peer's first sight after the first of all."""
    a = base.ann(spark, root)
    focus = a.where("rank_in_tx > 1").agg(F.min("txid").alias("txid"))
    lanes = a.join(F.broadcast(focus), "txid").groupBy("txid", "peer_ip").agg(F.min("seen_us").alias("first_us"), F.count(F.lit(1)).alias("n"))
    return lanes.select("txid", "peer_ip", (F.col("first_us") - F.min("first_us").over(Window.partitionBy("txid"))).alias("offset_us"), "n")


@query("""WITH top AS (SELECT cluster_id, addresses, n_addresses FROM clusters ORDER BY n_addresses DESC, cluster_id LIMIT 50), m AS (SELECT cluster_id, unnest(addresses) AS address FROM top)
    SELECT x.cluster_id AS a_cluster, y.cluster_id AS b_cluster, count(*) AS n_edges FROM edges JOIN m x ON x.address = a JOIN m y ON y.address = b WHERE x.cluster_id <> y.cluster_id GROUP BY ALL
    UNION ALL SELECT x.cluster_id, x.cluster_id, count(*) FROM edges JOIN m x ON x.address = a JOIN m y ON y.address = b AND y.cluster_id = x.cluster_id GROUP BY ALL""")
def api05_cluster_graph(spark: SparkSession, root: str) -> DataFrame:
    """Induced edges among the fifty largest clusters."""
    top = table(spark, root, "clusters").orderBy(F.desc("n_addresses"), "cluster_id").limit(50)
    m = top.select("cluster_id", F.explode("addresses").alias("address"))
    e = table(spark, root, "edges").select("a", "b")
    j = e.join(m.select(F.col("address").alias("a"), F.col("cluster_id").alias("a_cluster")), "a").join(m.select(F.col("address").alias("b"), F.col("cluster_id").alias("b_cluster")), "b")
    return j.groupBy("a_cluster", "b_cluster").agg(F.count(F.lit(1)).alias("n_edges"))


@query(f"""WITH {base.TX}, d AS (SELECT txid, len(input_addresses) + len(output_addresses) AS degree FROM tx), k AS (SELECT * FROM d ORDER BY degree DESC, txid LIMIT 40),
    deg AS (SELECT address, count(*) AS n FROM (SELECT unnest(input_addresses) AS address FROM tx UNION ALL SELECT unnest(output_addresses) FROM tx) GROUP BY address),
    e AS (SELECT DISTINCT txid, address FROM (SELECT txid, unnest(list_concat(input_addresses, output_addresses)) AS address FROM tx JOIN k USING (txid)))
    SELECT txid, address, r FROM (SELECT txid, address, row_number() OVER (PARTITION BY txid ORDER BY n DESC, address) AS r FROM e JOIN deg USING (address)) WHERE r <= 2""")
def api06_address_graph(spark: SparkSession, root: str) -> DataFrame:
    """The forty busiest transactions with their two best-connected addresses each."""
    t = base.tx(spark, root)
    kept = t.withColumn("degree", F.size("input_addresses") + F.size("output_addresses")).orderBy(F.desc("degree"), "txid").limit(40)
    both = t.select(F.explode("input_addresses").alias("address")).union(t.select(F.explode("output_addresses")))
    degree = both.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    e = kept.select("txid", F.explode(F.array_distinct(F.concat("input_addresses", "output_addresses"))).alias("address")).join(degree, "address")
    w = Window.partitionBy("txid").orderBy(F.desc("n"), "address")
    return e.withColumn("r", F.row_number().over(w).cast("long")).where("r <= 2").select("txid", "address", "r")


@query("""SELECT count(*) AS n_sealed, count(DISTINCT txid) AS n_tx, count(DISTINCT src_ip) AS n_peers, (SELECT count(*) FROM clusters) AS n_clusters, (SELECT count(*) FROM edges) AS n_edges,
    (SELECT count(DISTINCT txid) FROM origin_estimates WHERE NOT abstain) AS n_answered FROM sealed""")
def api10_funnel(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "sealed").agg(F.count(F.lit(1)).alias("n_sealed"), F.count_distinct("txid").alias("n_tx"), F.count_distinct("src_ip").alias("n_peers"))
    one = lambda n, a: table(spark, root, n).agg(a)
    return s.join(one("clusters", F.count(F.lit(1)).alias("n_clusters"))).join(one("edges", F.count(F.lit(1)).alias("n_edges"))).join(table(spark, root, "origin_estimates").where("not abstain").agg(F.count_distinct("txid").alias("n_answered")))


@query(f"""WITH {base.SIDES}, t AS (SELECT txid, peer_ip, p_origin, margin FROM (SELECT *, row_number() OVER (PARTITION BY txid ORDER BY p_origin DESC, margin DESC, peer_ip) AS r FROM origin_estimates
        WHERE estimator = 'ensemble' AND rank = 1 AND NOT abstain AND p_origin IS NOT NULL AND NOT isnan(p_origin) AND peer_ip IS NOT NULL) WHERE r = 1),
      {network.SUBJECTS}, o AS (SELECT DISTINCT c.subject_id, s.txid FROM subject_map c JOIN sides s ON s.address = c.address WHERE side = 'out')
    SELECT subject_id, txid AS origin_txid, peer_ip AS origin_peer_ip FROM (SELECT o.subject_id, t.*, row_number() OVER (PARTITION BY subject_id ORDER BY p_origin DESC, margin DESC NULLS LAST, t.txid) AS k FROM o JOIN t USING (txid)) WHERE k = 1""")
def alr02_anchor(spark: SparkSession, root: str) -> DataFrame:
    """Of each subject's receipts the transaction with the surest origin."""
    from peerlens.operators.normalise import sides

    e = table(spark, root, "origin_estimates").where((F.col("estimator") == "ensemble") & (F.col("rank") == 1) & ~F.col("abstain") & F.col("p_origin").isNotNull() & ~F.isnan("p_origin") & F.col("peer_ip").isNotNull())
    best = Window.partitionBy("txid").orderBy(F.desc("p_origin"), F.col("margin").desc_nulls_last(), "peer_ip")
    top = e.withColumn("r", F.row_number().over(best)).where("r = 1").select("txid", "peer_ip", "p_origin", "margin")
    got = network.subjects(spark, root).join(sides(base.tx(spark, root)).where("side = 'out'").select("address", "txid"), "address").select("subject_id", "txid").distinct()
    w = Window.partitionBy("subject_id").orderBy(F.desc("p_origin"), F.col("margin").desc_nulls_last(), "txid")
    return got.join(top, "txid").withColumn("k", F.row_number().over(w)).where("k = 1").select("subject_id", F.col("txid").alias("origin_txid"), F.col("peer_ip").alias("origin_peer_ip"))


@query(f"""WITH {base.SIDES}, {scoring.network.SUBJECTS}, s AS (SELECT DISTINCT subject_id, txid FROM sides JOIN subject_map USING (address) WHERE side = 'in'),
    a AS (SELECT txid, bool_and(abstain) AS refused FROM origin_estimates WHERE estimator = 'ensemble' GROUP BY txid), m AS (SELECT txid, sum(floor(p_origin * 1000000 + 0.5)::BIGINT)::BIGINT AS mass FROM origin_estimates WHERE estimator = 'ensemble' AND p_origin IS NOT NULL AND NOT isnan(p_origin) GROUP BY txid)
    SELECT subject_id, round(avg(coalesce(refused, true)::INT), 9) AS abstain_share, max(mass) AS top_mass_millionths FROM s LEFT JOIN a USING (txid) LEFT JOIN m USING (txid) GROUP BY subject_id""")
def alr05_abstain_share(spark: SparkSession, root: str) -> DataFrame:
    """Share of a subject's sends without an answer, and the largest observed origin mass."""
    from peerlens.operators.normalise import sides
    from peerlens.plans.network import subjects

    s = sides(base.tx(spark, root)).where("side = 'in'").join(subjects(spark, root), "address").select("subject_id", "txid").distinct()
    e = table(spark, root, "origin_estimates").where("estimator = 'ensemble'")
    per = e.groupBy("txid").agg(F.bool_and("abstain").alias("refused"), F.sum(F.when(F.col("p_origin").isNotNull() & ~F.isnan("p_origin"), F.floor(F.col("p_origin") * 1_000_000 + 0.5))).alias("mass"))
    return s.join(per, "txid", "left").groupBy("subject_id").agg(F.round(F.avg(F.coalesce("refused", F.lit(True)).cast("int")), 9).alias("abstain_share"), F.max("mass").alias("top_mass_millionths"))
