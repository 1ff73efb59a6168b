"""Queries of the models, embeddings, selection and streaming operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators import evaluate, evidence, features, graph, models, normalise
from peerlens.plans import base, network, scoring
from peerlens.runtime import durable, shared_dir, table
from peerlens.streaming import first_seen

FEATURES = list(features.SUBJECT_FEATURES)


def labelled(spark: SparkSession, root: str) -> DataFrame:
    """Subjects with all 33 features of their window, their first instant and a label.

    The label is whether a subject of the training window acts again after it, which
    none of its features sees; subjects of the other window have none.
    """
    acted = features.tx_sides(base.tx(spark, root)).join(network.subjects(spark, root), "address").groupBy("subject_id").agg(F.min("first_seen_us").alias("t"), F.max("first_seen_us").alias("last_us"))
    f = scoring.ftr13_subject_table(spark, root).join(acted, "subject_id")
    return durable(f.withColumn("y", F.when(F.col("is_train"), F.col("last_us") >= scoring.BOUNDARY_US)), "labelled")


def mdl01_scores(spark: SparkSession, root: str) -> DataFrame:
    """MDL-01 to 08: trees trained on the earlier part by time, calibrated on the later, all subjects scored with sets."""
    out = models.train_and_score(labelled(spark, root), FEATURES, "y", "subject_id", "t")
    return out.select("subject_id", F.round("risk", 6).alias("risk"), "label", F.round("conf_low", 6).alias("conf_low"), F.round("conf_high", 6).alias("conf_high"), F.to_json("top_features").alias("top_features"))


def mdl09_frozen(spark: SparkSession, root: str) -> DataFrame:
    """Scoring by a model that was frozen to a file with its digest, Platt line included, and read again."""
    data = labelled(spark, root)
    parts = durable(evaluate.split_by_time(data.where("y is not null"), ["t", "subject_id"], 0.75), "frozen-parts")
    model = models.train_trees(parts.where("part = 'train'"), FEATURES, "y", trees=5, depth=3)
    model = models.with_platt(model, parts.where("part = 'rest'"), "y")
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(model), models.digest(model))], "model string, digest string").coalesce(1).write.json(path)
    frozen = spark.read.schema("model string, digest string").json(path).first()
    return models.score(data, json.loads(frozen["model"]), "subject_id", expected_digest=frozen["digest"]).select("subject_id", F.round("margin", 6).alias("margin"), F.round("risk", 6).alias("risk"))


def ftr14_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """Eight dimensions of every address and transaction node."""
    t = base.tx(spark, root)
    edges = graph.spends(t).unionByName(graph.receives(t))
    ends = edges.select(F.col("src").alias("node_id"), "sats", F.lit(1.0).alias("o"), F.lit(0.0).alias("i")).unionByName(edges.select(F.col("dst").alias("node_id"), "sats", F.lit(0.0).alias("o"), F.lit(1.0).alias("i")))
    design = ends.groupBy("node_id").agg(
        F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.log1p(F.coalesce(F.sum("sats"), F.lit(0)).cast("double")).alias("log_sats"), F.log1p(F.count(F.lit(1))).alias("log_degree"),
        F.max(F.col("node_id").startswith("addr:").cast("double")).alias("is_addr"), F.max(F.col("node_id").startswith("tx:").cast("double")).alias("is_tx"), F.coalesce(F.avg("sats"), F.lit(0.0)).alias("mean_sats"), F.count("sats").cast("double").alias("n_priced"),
    )
    out = models.embeddings(edges, design, dim=8)
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c != "node_id"})


def alr07_diverse_leads(spark: SparkSession, root: str) -> DataFrame:
    """Twenty subjects whose transactions overlap little, those that received most first."""
    s = normalise.sides(base.tx(spark, root)).join(network.subjects(spark, root), "address")
    scored = s.groupBy("subject_id").agg(F.sum(F.when(F.col("side") == "out", F.col("sats"))).alias("score"), F.array_sort(F.collect_set("txid")).alias("support"))
    chosen = evidence.diverse(scored, "subject_id", "score", "support", 20)
    return spark.createDataFrame(list(enumerate(chosen, 1)), "place long, subject_id string")


def stm01_first_sights(spark: SparkSession, root: str) -> DataFrame:
    """All announcements with an instant replayed as a stream: the first announcer of each transaction that became final.

    What is final: all transactions whose horizon the last announcement has passed.
    """
    sealed = table(spark, root, "sealed")
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a stream takes instants up to 1970 for late; the clock is moved by whole milliseconds so that it starts after 0
    moved = (sealed.agg(F.min("ts_us")).first()[0] or 0) // 1_000 * 1_000 - 1_000_000
    rows = sealed.where("ts_us is not null").select((F.col("ts_us") - moved).alias("ts_us"), "txid", "src_ip", "msg_type")
    rows.write.parquet(f"{home}/in")
    stream = first_seen.with_event_time(spark.readStream.schema(rows.schema).parquet(f"{home}/in"), late="0 seconds")
    q = first_seen.first_sights(stream).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("txid string, first_us long, src_ip string, n long").parquet(f"{home}/out").withColumn("first_us", F.col("first_us") + moved)


def stm01_rejects(spark: SparkSession, root: str) -> DataFrame:
    """The announcements that ``stm01_first_sights`` cannot replay: they have no instant."""
    return table(spark, root, "sealed").where("ts_us is null").select("row_id", "txid", "src_ip", F.lit("no_instant").alias("reason"))


def stm02_windows(spark: SparkSession, root: str) -> DataFrame:
    """Hourly announcement windows of the stream, as the batch form of the same plan."""
    sealed = table(spark, root, "sealed").where("ts_us is not null").withColumn("at", F.timestamp_micros("ts_us"))
    return first_seen.announcement_windows(sealed).select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "msg_type", "n")


QUERIES = {f.__name__: f for f in (mdl01_scores, mdl09_frozen, ftr14_embeddings, alr07_diverse_leads, stm01_first_sights, stm01_rejects, stm02_windows)}
ORACLES = {
    "alr07_diverse_leads": f"""WITH RECURSIVE {base.SIDES}, {network.SUBJECTS},
      scored AS (SELECT subject_id, (sum(sats) FILTER (side = 'out'))::BIGINT AS score, list_sort(list(DISTINCT txid)) AS support FROM sides JOIN subject_map USING (address) GROUP BY subject_id),
      pool AS (SELECT subject_id, support, row_number() OVER (ORDER BY score DESC, subject_id) AS i FROM scored WHERE score IS NOT NULL QUALIFY i <= 2000),
      walk(i, ids, sets) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[][] UNION ALL
        SELECT i, CASE WHEN ok THEN list_append(ids, subject_id) ELSE ids END, CASE WHEN ok THEN list_append(sets, support) ELSE sets END FROM (
          SELECT p.i, ids, sets, subject_id, support, len(list_filter(sets, lambda t: len(list_intersect(t, support)) > 0.25 * len(list_distinct(list_concat(t, support))))) = 0 AS ok
          FROM walk w JOIN pool p ON p.i = w.i + 1 WHERE len(ids) < 20))
      SELECT unnest(range(1, len(ids) + 1)) AS place, unnest(ids) AS subject_id FROM (SELECT ids FROM walk ORDER BY i DESC LIMIT 1)""",
    "stm01_rejects": "SELECT row_id, txid, src_ip, 'no_instant' AS reason FROM sealed WHERE ts_us IS NULL",
    "stm01_first_sights": """WITH s AS (SELECT ts_us, txid, src_ip FROM sealed WHERE ts_us IS NOT NULL), f AS (SELECT txid, min(ts_us) AS first_us FROM s GROUP BY txid), m AS (SELECT max(ts_us) // 1000 AS top FROM s)
      SELECT f.txid, first_us, min(src_ip) FILTER (ts_us = first_us) AS src_ip, count(*) FILTER (ts_us <= first_us + 5000000) AS n FROM f JOIN s USING (txid) JOIN m ON (first_us + 5000000) // 1000 + 1 < top GROUP BY f.txid, first_us""",
    "stm02_windows": """SELECT h * 3600000000 AS start_us, (h + 1) * 3600000000 AS end_us, msg_type, count(*) AS n FROM (SELECT *, floor(ts_us / 3600000000.0)::BIGINT AS h FROM sealed WHERE ts_us IS NOT NULL) GROUP BY ALL""",
}
