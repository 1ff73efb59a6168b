"""Patterns in what a subject sends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.functions.text import hash_id

# Least fan-out, equal outputs, peel share of the whole, spread of equal payments and their number.
FAN_OUT, EQUAL_OUT, PEEL_SHARE, SPREAD, PAYMENTS = 6, 3, 0.35, 0.15, 3


def subjects(clusters: DataFrame, addresses: DataFrame) -> DataFrame:
    """(subject_id, address): the cluster of an address, or the address as its own subject."""
    grouped = clusters.select(F.col("cluster_id").alias("subject_id"), F.explode("addresses").alias("address")).where(F.col("address").isNotNull()).groupBy("address").agg(F.min("subject_id").alias("subject_id"))
    single = addresses.select("address").distinct().join(grouped, "address", "left_anti").select(F.concat(F.lit("addr:"), "address").alias("subject_id"), "address")
    return grouped.select("subject_id", "address").unionByName(single)


def sent(tx: DataFrame, subject_map: DataFrame) -> DataFrame:
    """One row per subject and transaction that it signed, with the shape of the transaction."""
    spends = tx.where(~F.col("is_coinbase")).select("txid", "n_out", "total_out_sats", "has_equal_outputs", F.array_min("output_amounts").alias("min_out_sats"), F.explode(F.array_distinct("input_addresses")).alias("address"))
    return spends.join(subject_map, "address").drop("address").dropDuplicates(["subject_id", "txid"])


def hits(sent_rows: DataFrame) -> DataFrame:
    """(hit_id, typology, subject_id, txids, strength, threshold) of all four detectors.

    All detectors share one grouping per subject; null amounts satisfy none. The
    lists of transactions are part of the contract, so a subject's list is as long
    as its matching sends.
    """
    total = F.col("total_out_sats")
    rules = {
        "fan_out": (F.col("n_out") >= FAN_OUT, lambda c: F.max(F.when(c, F.col("n_out"))), lambda n, c: n > 0, FAN_OUT),
        "coinjoin_like": (F.col("has_equal_outputs") & (F.col("n_out") >= EQUAL_OUT), F.count_if, lambda n, c: n > 0, EQUAL_OUT),
        "peel_chain": ((F.col("n_out") == 2) & (F.col("min_out_sats") <= PEEL_SHARE * total), F.count_if, lambda n, c: n >= 2, PEEL_SHARE),
        "structuring": (
            (F.col("n_out") == 1) & total.isNotNull(), F.count_if,
            lambda n, c: (n >= PAYMENTS) & (F.avg(F.when(c, total)) > 0) & (F.stddev_samp(F.when(c, total)) <= SPREAD * F.avg(F.when(c, total))), SPREAD,
        ),
    }
    found = []
    for name, (rule, strength, having, threshold) in rules.items():
        c = F.coalesce(rule, F.lit(False))
        found.append(F.struct(
            F.lit(name).alias("typology"), F.array_sort(F.collect_set(F.when(c, F.col("txid")))).alias("txids"),
            strength(c).cast("double").alias("strength"), F.lit(float(threshold)).alias("threshold"), F.coalesce(having(F.count_if(c), c), F.lit(False)).alias("ok"),
        ))
    rows = sent_rows.groupBy("subject_id").agg(F.array(*found).alias("_h")).select("subject_id", F.explode(F.filter("_h", lambda h: h["ok"])).alias("_h"))
    return rows.select(hash_id(F.concat(F.col("_h.typology"), F.lit(":"), "subject_id")).alias("hit_id"), "_h.typology", "subject_id", "_h.txids", "_h.strength", "_h.threshold")


def entity_types(spark) -> DataFrame:
    """The table of entity types: its columns are fixed, and no rule fills it."""
    return spark.createDataFrame([], "subject_id string, predicted_type string, confidence double, basis array<string>, exempt_from_scoring boolean")
