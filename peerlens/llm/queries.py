"""Queries of the text and match problems (1, 3, 8, 9 and 10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm import clusters, confusables, leakage, tokenizer, topn
from peerlens.runtime import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    claims = table(spark, root, "edges").where((F.col("kind") == "SAME_OWNER") & (F.col("confidence") >= 0.2) & ~F.isnan("confidence"))
    return clusters.groups(claims.select("a", "b"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return topn.top_n(table(spark, root, "origin_estimates"), ["txid", "estimator"], "peer_ip", "p_origin", 3)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, root, "documents"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_paraphrases(spark: SparkSession, root: str) -> DataFrame:
    return leakage.paraphrases(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return confusables.look_alike_pairs(table(spark, root, "documents"))


def p10_forms(spark: SparkSession, root: str) -> DataFrame:
    return confusables.normalised_texts(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p3_found, p8_ids, p9_found, p9_paraphrases, p10_found, p10_forms)
}

ORACLES: dict[str, str] = {
    "p1_found": """
        WITH RECURSIVE e AS (
          SELECT DISTINCT a AS u, b AS v FROM edges
          WHERE kind = 'SAME_OWNER' AND confidence >= 0.2 AND NOT isnan(confidence) AND a IS NOT NULL AND b IS NOT NULL AND a <> b),
        s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        r(address, reach) AS (
          SELECT DISTINCT u, u FROM s
          UNION
          SELECT r.address, s.v FROM r JOIN s ON s.u = r.reach WHERE s.v < r.address OR s.v > r.address)
        SELECT address, min(reach) AS cluster_id FROM r GROUP BY address""",
    "p3_found": """
        WITH b AS (
          SELECT txid, estimator, peer_ip, max(p_origin) AS p FROM origin_estimates
          WHERE p_origin IS NOT NULL AND NOT isnan(p_origin) AND peer_ip IS NOT NULL AND txid IS NOT NULL AND estimator IS NOT NULL
          GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY txid, estimator ORDER BY p DESC, peer_ip) AS place FROM b)
        SELECT txid, estimator, peer_ip, place FROM r WHERE place <= 3""",
}
