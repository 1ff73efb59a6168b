"""Measures: ranking curves, pairwise grouping quality, conformal sets, splits, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.functions.stats import majority
from peerlens.runtime import durable


def time_boundary(first_us: int, last_us: int, fraction: float) -> int:
    """First microsecond of the later part of a span, half-open; an empty span ends after it."""
    return last_us + 1 if last_us <= first_us else first_us + int((last_us - first_us) * fraction)


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg) per distinct score: ties are one step of every curve."""
    y = F.col(label).cast("int")
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & y.isNotNull()
    return df.where(ok).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg"))


def curve_areas(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: roc_auc (mid-rank), pr_auc (ties count negatives first), n_pos, n_neg.

    Areas are null unless both classes occur. Rows with a null score or label
    are left out. Distinct scores are accumulated per range partition, so no
    task holds all of them.
    """
    steps = _by_score(df, score, label)
    ranged = steps.repartitionByRange(F.desc("score")).withColumn("_p", F.spark_partition_id())
    ranged = durable(ranged, "curve")
    totals = ranged.groupBy("_p").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), F.max("score").alias("_top"))
    w = Window.orderBy(F.desc("_top")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = totals.select("_p", F.coalesce(F.sum("_pos").over(w), F.lit(0)).alias("_pos0"), F.coalesce(F.sum("_neg").over(w), F.lit(0)).alias("_neg0"))
    inner = Window.partitionBy("_p").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    cum = ranged.join(F.broadcast(before), "_p").select("pos", "neg", (F.col("_pos0") + F.sum("pos").over(inner)).alias("cp"), (F.col("_neg0") + F.sum("neg").over(inner)).alias("cn"))
    # a positive beats every negative below it and half of those beside it
    wins = F.sum(F.col("neg") * (F.col("cp") - F.col("pos")) + 0.5 * F.col("neg") * F.col("pos"))
    # negatives of a tie come first: the i-th positive of a step has precision (before + i) / (before + i + all negatives so far)
    start = F.col("cp") - F.col("pos")
    part = F.aggregate(F.sequence(F.lit(1), F.greatest("pos", F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(F.col("pos") > 0, (start + i) / (start + i + F.col("cn"))).otherwise(0.0))
    r = cum.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("_wins"), F.sum(part).alias("_prec"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return r.select(F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"), F.when(both, F.col("_wins") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"), F.when(both, F.col("_prec") / F.col("n_pos")).alias("pr_auc"))


def at_k(df: DataFrame, score: str, label: str, id_col: str, k: int = 20) -> DataFrame:
    """One row: precision and recall of the k best, ties by id ascending."""
    top = df.where(F.col(score).isNotNull()).orderBy(F.desc(score), F.asc(id_col)).limit(k)
    hit = top.agg(F.sum(F.col(label).cast("int")).alias("h"), F.count(F.lit(1)).alias("n"))
    total = df.agg(F.sum(F.col(label).cast("int")).alias("all"))
    return hit.join(total).select((F.col("h") / F.col("n")).alias("precision_at_k"), F.when(F.col("all") > 0, F.col("h") / F.col("all")).alias("recall_at_k"))


def pair_quality(predicted: DataFrame, truth: DataFrame, member: str, group_p: str, group_t: str) -> DataFrame:
    """One row: pairwise precision, recall and F1 over members that both sides know.

    Pairs are counted from group sizes, n (n - 1) / 2 each; no pair is built.
    """
    both = predicted.select(member, group_p).distinct().join(truth.select(member, group_t).distinct(), member)
    pairs = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    size = lambda *g: both.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    p, t, b = (size(*g).agg(pairs("n").alias(a)) for g, a in (((group_p,), "in_pred"), ((group_t,), "in_true"), ((group_p, group_t), "in_both")))
    r = p.join(t).join(b)
    precision, recall = F.when(F.col("in_pred") > 0, F.col("in_both") / F.col("in_pred")), F.when(F.col("in_true") > 0, F.col("in_both") / F.col("in_true"))
    return r.select(precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).alias("f1"))


def split_by_time(df: DataFrame, order: list[str], fraction: float, out: str = "part") -> DataFrame:
    """Marks the first ``fraction`` of the rows in a total order ``train``, the rest ``rest``."""
    n = df.count()
    cut = int(n * fraction)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = durable(ranged, "split")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_lo"))
    before = sizes.select("_p", "_lo", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # one row per range
    place = F.col("_b") + F.col("_i") - F.col("_lo")
    return ranged.join(F.broadcast(before), "_p").withColumn(out, F.when(place < cut, "train").otherwise("rest")).drop("_p", "_i", "_n", "_lo", "_b")


def conformal_quantiles(cal: DataFrame, prob: str, label: str, alpha: float = 0.1, least_rows: int = 50, least_class: int = 10) -> dict[int, float]:
    """Per class the conformal quantile of 1 - p(class); infinite where it cannot be had.

    Class-conditional if there are enough calibration rows of both classes,
    else one quantile for both. At most two numbers reach the driver.
    """
    score = cal.select(F.col(label).cast("int").alias("y"), F.when(F.col(label).cast("int") == 1, 1 - F.col(prob)).otherwise(F.col(prob)).alias("s"))
    sizes = {r["y"]: r["n"] for r in score.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = sum(sizes.values()) >= least_rows and len(sizes) == 2 and min(sizes.values()) >= least_class

    def quantile(rows: DataFrame, n: int) -> float:
        level = -(-(n + 1) * (1 - alpha) // 1)
        if n == 0 or level > n:
            return float("inf")
        return rows.agg(F.percentile("s", 0.0 if n == 1 else (level - 1) / (n - 1))).first()[0]

    if split:
        return {y: quantile(score.where(F.col("y") == y), n) for y, n in sizes.items()}
    q = quantile(score, sum(sizes.values()))
    return {0: q, 1: q}


def conformal_sets(df: DataFrame, prob: str, quantiles: dict[int, float]) -> DataFrame:
    """Adds in_set_0 and in_set_1, the label of the set, and the display band."""
    in0, in1 = F.col(prob) <= F.lit(quantiles.get(0, float("inf"))), (1 - F.col(prob)) <= F.lit(quantiles.get(1, float("inf")))
    label = F.when(in0 & in1, "UNCLEAR").when(in1, "LIKELY_ILLICIT").when(in0, "LIKELY_LICIT").otherwise("ABSTAIN")
    both = in0 & in1
    low = F.when(both, 0.0).otherwise(F.greatest(F.col(prob) * 0.85, F.lit(0.0)))
    high = F.when(both, 1.0).otherwise(F.least(F.col(prob) * 1.15, F.lit(1.0)))
    return df.withColumns({"in_set_0": in0, "in_set_1": in1, "label": label, "conf_low": low, "conf_high": high})


def coverage(sets: DataFrame, truth: str) -> DataFrame:
    """(truth, n, coverage): share of rows whose set holds their class."""
    hit = F.when(F.col(truth).cast("int") == 1, F.col("in_set_1")).otherwise(F.col("in_set_0"))
    return sets.groupBy(F.col(truth).cast("int").alias("truth")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("coverage"))


def brier(df: DataFrame, prob: str, label: str) -> DataFrame:
    """One row: Brier score and F1 at one half."""
    y, p = F.col(label).cast("int"), F.col(prob)
    up = p >= 0.5
    tp, fp, fn = F.sum((up & (y == 1)).cast("int")), F.sum((up & (y == 0)).cast("int")), F.sum((~up & (y == 1)).cast("int"))
    return df.agg(F.avg((p - y) * (p - y)).alias("brier"), F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("f1_at_half"))


def estimate_violations(estimates: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(rule, n): rows or transactions of an estimate table that break a contract rule."""
    per_tx = estimates.groupBy("txid", "estimator").agg(
        F.sum("p_origin").alias("mass"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("ranks"), F.bool_or("abstain").alias("abstain"),
        F.count_distinct("margin").alias("margins"),
    )
    rule = lambda name, cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(name)
    first = F.when(F.col("abstain"), 2).otherwise(1)
    r = per_tx.agg(
        rule("mass_above_one", F.col("mass") > 1 + tolerance), rule("rank_gap", (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("ranks") != F.col("n"))),
        rule("wrong_first_rank", F.col("lo") != first), rule("margin_differs", F.col("margins") != 1),
    )
    return r.unpivot([], ["mass_above_one", "rank_gap", "wrong_first_rank", "margin_differs"], "rule", "n")


def histogram(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, n): rows per key."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def label_door(truth: DataFrame, seen: DataFrame, key: str, first: str, boundary_us: int) -> DataFrame:
    """``truth`` of the keys that were seen, with ``is_training``: first seen before the boundary.

    Keys that nobody saw have no side and are left out; what is not of the training
    side must stay closed to whoever trains.
    """
    return truth.join(seen.groupBy(key).agg(F.min(first).alias("_first")).where(F.col("_first").isNotNull()), key).withColumn("is_training", F.col("_first") < boundary_us).drop("_first")


def wallet_report(predicted: DataFrame, owners: DataFrame, boundary_us: int, k: int = 20) -> DataFrame:
    """One row: how well scored subjects match the truth of the addresses first seen from the boundary on.

    ``predicted`` has one row per subject and address (subject_id, address, risk,
    in_set_0, in_set_1), ``owners`` one per address (address, entity_id, is_illicit,
    first_us). A subject is illicit if more than half of its such addresses are; ties
    are licit. Grains: subjects (precision and recall of the k best, coverage of the
    sets by class) and illicit entities, of which one is caught if a flagged subject
    holds one of its addresses.
    """
    late = owners.where(F.col("first_us") >= boundary_us).groupBy("address").agg(F.min("entity_id").alias("entity_id"), F.bool_or("is_illicit").alias("is_illicit"))
    joined = predicted.join(late, "address")
    subjects = joined.groupBy("subject_id").agg(majority(F.col("is_illicit")).alias("y"), F.max("risk").alias("risk"), F.bool_or("in_set_0").alias("in_set_0"), F.bool_or("in_set_1").alias("in_set_1"))
    sets = subjects.agg(
        F.count(F.lit(1)).alias("n_subjects"), F.count_if("y").alias("n_illicit"), F.avg(F.when(~F.col("y"), F.col("in_set_0").cast("int"))).alias("coverage_licit"), F.avg(F.when(F.col("y"), F.col("in_set_1").cast("int"))).alias("coverage_illicit"),
    )
    flagged = predicted.where("in_set_1").select("address").distinct().withColumn("_hit", F.lit(True))
    caught = late.where("is_illicit").join(flagged, "address", "left").groupBy("entity_id").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("hit"))
    return sets.join(at_k(subjects, "risk", "y", "subject_id", k)).join(caught.agg(F.count(F.lit(1)).alias("campaigns"), F.count_if("hit").alias("caught")))
