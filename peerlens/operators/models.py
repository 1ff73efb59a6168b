"""Boosted trees with calibrated sets, path attributions and subject embeddings.

Training uses MLlib; scoring evaluates exported trees in Arrow batches, so a
frozen model is plain data. Values differ from other boosting libraries; what is
kept are the contracts: contributions sum to the margin, splits are by time, sets
are conformal, and everything is repeatable for a seed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.operators.evaluate import conformal_quantiles, conformal_sets, split_by_time
from peerlens.runtime import durable


def _matrix(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=features, outputCol="_x").transform(filled)


def train_trees(df: DataFrame, features: list[str], label: str, seed: int = 42, trees: int = 20, depth: int = 4) -> dict:
    """A frozen boosted classifier as plain data; needs both classes."""
    from pyspark.ml.classification import GBTClassifier

    data = _matrix(df.where(F.col(label).isNotNull()), features).select("_x", F.col(label).cast("double").alias("_y"))
    model = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=seed).fit(data)
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[dict] = []

        def walk(node, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append({})
            count = float(node.impurityStats().count())
            if node.numDescendants() == 0:
                nodes[at] = {"value": float(node.prediction()), "count": count}
            else:
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                total = nodes[left]["count"] + nodes[right]["count"]
                value = (nodes[left]["value"] * nodes[left]["count"] + nodes[right]["value"] * nodes[right]["count"]) / total
                nodes[at] = {"feature": int(split.featureIndex()), "cut": float(split.threshold()), "left": left, "right": right, "value": value, "count": count}
            return at

        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"))
        out.append({"weight": float(weight), "nodes": nodes})
    return {"features": features, "trees": out}


def digest(model: dict) -> str:
    """Digest of a frozen model, over its canonical JSON."""
    return hashlib.sha256(json.dumps(model, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def contributions(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bias, contributions): what each feature adds to the margin along the tree paths.

    The change of the expected value at every split on a row's path is credited
    to the split feature, so bias and contributions sum to the margin exactly.
    """
    n, m = x.shape
    out, bias = np.zeros((n, m)), 0.0
    for tree in model["trees"]:
        nodes, weight = tree["nodes"], tree["weight"]
        bias += weight * nodes[0]["value"]
        at = np.zeros(n, np.int64)
        feature = np.array([k.get("feature", -1) for k in nodes])
        cut = np.array([k.get("cut", 0.0) for k in nodes])
        left, right = np.array([k.get("left", 0) for k in nodes]), np.array([k.get("right", 0) for k in nodes])
        value = np.array([k["value"] for k in nodes])
        while True:
            live = np.flatnonzero(feature[at] >= 0)
            if not len(live):
                break
            here = at[live]
            f = feature[here]
            down = np.where(x[live, f] <= cut[here], left[here], right[here])
            out[live, f] += weight * (value[down] - value[here])
            at[live] = down
    return np.full(n, bias), out


def _risk(model: dict, margin: np.ndarray) -> np.ndarray:
    """Probability of a margin: by the model's Platt line if it has one, else the booster's own logistic."""
    slope, intercept = model.get("platt", (2.0, 0.0))
    return 1 / (1 + np.exp(-(slope * margin + intercept)))


def with_risk(df: DataFrame, model: dict, out: str) -> DataFrame:
    """All rows and columns with the probability by a frozen model; null and NaN features count as 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=float) for c in columns]), nan=0.0)
        bias, parts = contributions(shared.value, x)
        return pd.Series(_risk(shared.value, bias + parts.sum(axis=1)))

    return df.withColumn(out, run(*[F.col(f).cast("double") for f in model["features"]]))


def with_platt(model: dict, cal: DataFrame, label: str, least_rows: int = 50) -> dict:
    """The model with a Platt line, a logistic regression of the label on the margin.

    Rows without a label do not count. Below ``least_rows`` rows, or with one
    class, the model stays uncalibrated.
    """
    from pyspark.ml.classification import LogisticRegression

    known = cal.where(F.col(label).isNotNull())
    n, classes = known.agg(F.count(F.lit(1)), F.count_distinct(F.col(label).cast("int"))).first()
    if n < least_rows or classes < 2:
        return model
    risk = F.col("_risk")  # of the plain model, so the margin is half its log-odds
    margins = with_risk(known, {k: v for k, v in model.items() if k != "platt"}, "_risk").select(F.col(label).cast("double").alias("_y"), (F.log(risk / (1 - risk)) / 2).alias("_margin"))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / n, standardization=False, maxIter=1000).fit(_matrix(margins, ["_margin"]))
    return {**model, "platt": [float(fit.coefficients[0]), float(fit.intercept)]}


def score(df: DataFrame, model: dict, id_col: str, top: int = 5, expected_digest: str | None = None) -> DataFrame:
    """(id, margin, risk, top_features) of every row by a frozen model.

    Null and NaN features count as 0. ``top_features`` are the largest
    contributions by size, then name, rounded to 6 digits.
    """
    if expected_digest and digest(model) != expected_digest:
        raise ValueError("the model is not the one that was frozen")
    features = model["features"]
    id_type = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frozen = shared.value
        for frame in frames:
            x = np.nan_to_num(frame[features].to_numpy(dtype=float), nan=0.0)
            bias, parts = contributions(frozen, x)
            margin = bias + parts.sum(axis=1)
            order = np.argsort(-np.abs(np.round(parts, 6)), axis=1, kind="stable")[:, :top]
            best = [[{"name": features[j], "value": round(float(row[j]), 6)} for j in sorted(o, key=lambda j: (-abs(round(row[j], 6)), features[j]))] for row, o in zip(parts, order, strict=True)]
            yield pd.DataFrame({id_col: frame[id_col], "margin": margin, "risk": _risk(frozen, margin), "top_features": best})

    slim = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features])
    return slim.mapInPandas(run, f"`{id_col}` {id_type}, margin double, risk double, top_features array<struct<name: string, value: double>>")


def overlay(df: DataFrame, plain: dict, extended: dict, extra: list[str]) -> DataFrame:
    """All rows with ``risk`` and ``model``: the extended model's where all ``extra`` features are known, else the plain one's."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in extra])
    both = with_risk(with_risk(df, plain, "_plain"), extended, "_extended")
    return both.withColumn("risk", F.when(known, F.col("_extended")).otherwise(F.col("_plain"))).withColumn("model", F.when(known, "extended").otherwise("plain")).drop("_plain", "_extended")


def train_and_score(df: DataFrame, features: list[str], label: str, id_col: str, time_col: str, fraction: float = 0.75, alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """Train on the first part by time, calibrate on the rest, and score all rows with conformal sets."""
    known = durable(split_by_time(df.where(F.col(label).isNotNull()), [time_col, id_col], fraction), "recipe")
    model = train_trees(known.where("part = 'train'"), features, label, seed)
    scored = durable(score(df, model, id_col), "scores")
    cal = known.where("part = 'rest'").select(id_col, label).join(scored.select(id_col, "risk"), id_col)
    return conformal_sets(scored, "risk", conformal_quantiles(cal, "risk", label, alpha))


def embeddings(edges: DataFrame, design: DataFrame, dim: int = 8, hops: int = 2) -> DataFrame:
    """(node_id, e0, ...): propagated and reduced node features.

    ``design`` has node_id and numeric columns; they are standardised, averaged
    over neighbours (and the node itself) ``hops`` times by joins, and projected
    on the leading directions of their Gram matrix, which is as small as the
    columns are few. The sign of a direction is fixed by its largest weight.
    """
    cols = [c for c in design.columns if c != "node_id"]
    stats = design.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    now = durable(design.select("node_id", *[((F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0)).alias(c) for c in cols]), "design")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    arcs = both.unionByName(now.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))).distinct()
    for _ in range(hops):
        sent = arcs.join(now.withColumnRenamed("node_id", "src"), "src")
        now = durable(sent.groupBy("dst").agg(*[F.avg(c).alias(c) for c in cols]).withColumnRenamed("dst", "node_id"), "hop")
    products = now.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    gram = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            gram[i, j] = gram[j, i] = products[f"{i}_{j}"] or 0.0
    _, vectors = np.linalg.eigh(gram)
    lead = vectors[:, ::-1][:, :dim]
    lead = lead * np.sign(lead[np.abs(lead).argmax(axis=0), np.arange(lead.shape[1])])
    return now.select("node_id", *[sum((F.col(c) * float(lead[i, k]) for i, c in enumerate(cols)), F.lit(0.0)).alias(f"e{k}") for k in range(lead.shape[1])])
