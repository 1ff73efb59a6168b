"""Queries of the generated world and of what needs its truth. They read no table: a world is its configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators import evaluate, features, generate, graph, models, normalise, origin, typology, world
from peerlens.operators.components import components
from peerlens.plans import learning
from peerlens.runtime import durable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _texts(df: DataFrame) -> DataFrame:
    """Lists as texts, so that any reader can compare them."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c, t in df.dtypes if t.startswith("array")})


@query
def gen01_population(spark: SparkSession, root: str) -> DataFrame:
    return _texts(world.frames(spark, world.configure())["entities"])


@query
def gen02_03_chain(spark: SparkSession, root: str) -> DataFrame:
    return _texts(world.frames(spark, world.configure())["transactions"])


@query
def gen04_campaigns(spark: SparkSession, root: str) -> DataFrame:
    return _texts(world.frames(spark, world.configure())["campaigns"])


@query
def gen08_regimes(spark: SparkSession, root: str) -> DataFrame:
    """Transactions, campaigns and hidden origins of each regime."""
    rows = []
    for name in (None, *world.REGIMES):
        made = world.build(world.configure(regime=name))
        rows.append((name or "default", len(made["transactions"]), len(made["campaigns"]), int(made["origins"]["true_net_class"].isin(["tor", "vpn_suspect"]).sum())))
    return spark.createDataFrame(rows, "regime string, n_tx long, n_campaigns long, n_hidden long")


@query
def gen10_origins(spark: SparkSession, root: str) -> DataFrame:
    return world.frames(spark, world.configure())["origins"]


@query
def gen12_vendor_lists(spark: SparkSession, root: str) -> DataFrame:
    return world.vendor_lists(spark, world.configure())


def chain(made: dict[str, DataFrame]) -> DataFrame:
    """The transactions of a world in the columns of the normalised ones; a transaction is seen when it is broadcast."""
    t = made["transactions"].join(made["origins"].select("txid", "broadcast_us"), "txid")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select(
        "txid", F.col("broadcast_us").alias("first_seen_us"), "input_addresses", "output_addresses", "input_amounts", "output_amounts", F.size("input_addresses").alias("n_in"), F.size("output_addresses").alias("n_out"),
        total("input_amounts").alias("total_in_sats"), total("output_amounts").alias("total_out_sats"), "fee_sats", (F.col("fee_sats") / F.col("vsize")).alias("fee_rate_sat_vb"), "is_coinbase",
        (F.size(F.array_distinct("output_amounts")) < F.size("output_amounts")).alias("has_equal_outputs"), F.lit(-1).alias("change_index"), "block_height",
    )


@query
def evl02_label_doors(spark: SparkSession, root: str) -> DataFrame:
    """Both doors on a flooded world: origins by transaction and owners by address, each on its side of the boundary."""
    made = world.frames(spark, world.configure())
    ann = durable(generate.flooded(made["origins"]), "flooded")
    lo, hi = ann.agg(F.min("seen_us"), F.max("seen_us")).first()
    cut = evaluate.time_boundary(lo, hi, 0.7)
    origins = evaluate.label_door(made["origins"].select("txid", F.col("true_ip").alias("label")), ann, "txid", "seen_us", cut).select(F.lit("origin").alias("door"), F.col("txid").alias("key"), "label", "is_training")
    sides = features.tx_sides(chain(made))
    owned = made["entities"].select(F.explode("addresses").alias("address"), F.col("entity_id").alias("label"))
    wallets = evaluate.label_door(owned, sides.select("address", "first_seen_us"), "address", "first_seen_us", cut).select(F.lit("wallet").alias("door"), F.col("address").alias("key"), "label", "is_training")
    return origins.unionByName(wallets)


@query
def evl04_by_window(spark: SparkSession, root: str) -> DataFrame:
    """Origin scores of the flooded world by window and traffic class, over all broadcast transactions, seen or not."""
    made = world.frames(spark, world.configure())
    ann = durable(generate.flooded(made["origins"]), "flooded")
    rows = normalise.announcements(generate.as_sealed(ann))
    none = spark.createDataFrame([], "peer_ip string, v_asn int, v_as_org string, v_net_class string, v_geo_country string")
    est = durable(origin.first_spy(origin.candidates(rows, normalise.peers(rows, none))), "estimates")
    truth = made["origins"].select("txid", "true_net_class", "broadcast_us").join(ann.select("txid", "true_peer").distinct(), "txid", "left")
    lo, hi = truth.agg(F.min("broadcast_us"), F.max("broadcast_us")).first()
    per = est.join(truth.select("txid", "true_peer"), "txid").groupBy("txid").agg(
        F.bool_and("abstain").alias("refused"), F.min(F.when(F.col("peer_ip") == F.col("true_peer"), F.col("rank") - F.col("abstain").cast("int"))).alias("true_rank"))
    joined = truth.join(per, "txid", "left").withColumn("window", F.when(F.col("broadcast_us") < evaluate.time_boundary(lo, hi, 0.7), "train").otherwise("holdout"))
    return joined.groupBy("window", "true_net_class").agg(
        F.count(F.lit(1)).alias("n_tx"), F.count("refused").alias("n_covered"), F.count_if(~F.col("refused")).alias("n_acted"), F.count_if(F.col("true_rank") == 1).alias("top1"), F.count_if(F.col("true_rank") <= 3).alias("top3"))


def _subjects(t: DataFrame) -> DataFrame:
    """(subject_id, address) of a world's chain: groups of addresses that spend together, and all others by themselves."""
    grouped = components(graph.multi_input_claims(t)).select(F.col("member").alias("address"), F.concat(F.lit("group:"), "root").alias("subject_id"))
    single = features.tx_sides(t).select("address").distinct().join(grouped, "address", "left_anti").select("address", F.concat(F.lit("addr:"), "address").alias("subject_id"))
    return durable(grouped.unionByName(single), "world-subjects")


@query
def evl07_wallets(spark: SparkSession, root: str) -> DataFrame:
    """Subjects of the world scored by their patterns, against the truth of the later addresses."""
    made = world.frames(spark, world.configure())
    t = durable(chain(made), "world-chain")
    members = _subjects(t)
    sides = features.tx_sides(t)
    first = sides.groupBy("address").agg(F.min("first_seen_us").alias("first_us"))
    owners = made["entities"].select("entity_id", "is_illicit", F.explode("addresses").alias("address")).join(first, "address")
    lo, hi = first.agg(F.min("first_us"), F.max("first_us")).first()
    cut = evaluate.time_boundary(lo, hi, 0.7)
    load = typology.hits(typology.sent(t, members)).groupBy("subject_id").agg(F.sum("strength").alias("s"))
    scored = members.join(load, "subject_id", "left").withColumn("risk", 1 - F.exp(-F.coalesce("s", F.lit(0.0)) / 10))
    early = owners.where(F.col("first_us") < cut).select("address", "is_illicit")
    cal = scored.join(early, "address").groupBy("subject_id").agg(F.max("risk").alias("risk"), (2 * F.sum(F.col("is_illicit").cast("int")) > F.count(F.lit(1))).alias("y"))
    sets = evaluate.conformal_sets(scored, "risk", evaluate.conformal_quantiles(cal, "risk", "y"))
    out = evaluate.wallet_report(sets.select("subject_id", "address", "risk", "in_set_0", "in_set_1"), owners, cut)
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


def _two_models(spark: SparkSession, root: str) -> DataFrame:
    """All subjects by the plain and the extended model, of which the second also sees the embeddings."""
    nodes = learning.ftr14_embeddings(spark, root)
    extra = [c for c in nodes.columns if c != "node_id"]
    members = learning.network.subjects(spark, root).withColumn("node_id", F.concat(F.lit("addr:"), "address"))
    mean = members.join(nodes, "node_id").groupBy("subject_id").agg(*[F.avg(c).alias(c) for c in extra])
    data = durable(learning.labelled(spark, root).join(mean, "subject_id", "left"), "two-models")
    parts = durable(evaluate.split_by_time(data.where("y is not null"), ["t", "subject_id"], 0.75), "two-parts").where("part = 'train'")
    plain = models.train_trees(parts, learning.FEATURES, "y", trees=5, depth=3)
    extended = models.train_trees(parts, [*learning.FEATURES, *extra], "y", trees=5, depth=3)
    out = models.overlay(models.with_risk(data, plain, "plain_risk"), plain, extended, extra)
    return durable(out.select("subject_id", "t", "y", "plain_risk", "risk", "model"), "overlay")


@query
def mdl07_overlay(spark: SparkSession, root: str) -> DataFrame:
    return _two_models(spark, root).select("subject_id", F.round("risk", 6).alias("risk"), "model")


@query
def evl14_embedding_gate(spark: SparkSession, root: str) -> DataFrame:
    """The extended model against what the plain one says of the same subjects, with one of a closed list of reasons."""
    data = _two_models(spark, root).where("model = 'extended' and y is not null")
    late = evaluate.split_by_time(data, ["t", "subject_id"], 0.75).where("part = 'rest'")
    a, b = (evaluate.curve_areas(late, c, "y").first()["pr_auc"] for c in ("plain_risk", "risk"))
    reason = "not_measurable" if a is None or b is None else "no_gain" if b <= a else "gain"
    return spark.createDataFrame([(a, b, reason == "gain", reason)], "plain_pr_auc double, extended_pr_auc double, ships boolean, reason string")
