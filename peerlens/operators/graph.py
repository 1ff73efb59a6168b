"""The typed graph of addresses, transactions, peers and operators, and ownership claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.functions import text
from peerlens.functions.arrays import paired
from peerlens.operators.components import components
from peerlens.runtime import durable

# Confidence of the two ownership heuristics, and of an operator looked up from a vendor table.
MULTI_INPUT, CHANGE, LOOKED_UP = 0.36, 0.25, 0.95
THRESHOLD = 0.2


def mixer() -> Column:
    """Whether a transaction looks like a joint one: equal outputs, three or more out, two or more in."""
    return F.col("has_equal_outputs") & (F.col("n_out") >= 3) & (F.col("n_in") >= 2)


def spends(tx: DataFrame) -> DataFrame:
    """Edges address -> transaction, one per input, with the amount."""
    rows = tx.select("txid", "first_seen_us", F.inline(paired("input_addresses", "input_amounts")))
    return _flow(rows, text.node_id("addr", F.col("address")), text.node_id("tx", F.col("txid")), "SPENDS")


def receives(tx: DataFrame) -> DataFrame:
    """Edges transaction -> address, one per output, with the amount."""
    rows = tx.select("txid", "first_seen_us", F.inline(paired("output_addresses", "output_amounts")))
    return _flow(rows, text.node_id("tx", F.col("txid")), text.node_id("addr", F.col("address")), "RECEIVES")


def _flow(rows: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return rows.where(F.col("address").isNotNull()).select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.col("first_seen_us").alias("ts_us"), "sats", F.lit(1.0).alias("confidence"), F.lit("observed").alias("evidence"))


def announced_by(ann: DataFrame) -> DataFrame:
    """Edges transaction -> peer, one per pair, at the first time."""
    pairs = ann.where(F.col("peer_ip").isNotNull()).groupBy("txid", "peer_ip").agg(F.min("seen_us").alias("ts_us"))
    return pairs.select(text.node_id("tx", F.col("txid")).alias("src"), text.node_id("peer", F.col("peer_ip")).alias("dst"), F.lit("ANNOUNCED_BY").alias("kind"), "ts_us", F.lit(None).cast("long").alias("sats"), F.lit(1.0).alias("confidence"), F.lit("observed").alias("evidence"))


def hosted_in(peers: DataFrame, own_asn: DataFrame) -> DataFrame:
    """Edges peer -> operator; ``own_asn`` lists the peers whose operator was in the capture."""
    looked = peers.where(F.col("asn").isNotNull()).join(own_asn.select("peer_ip", F.lit(True).alias("_own")), "peer_ip", "left")
    own = F.coalesce("_own", F.lit(False))
    return looked.select(
        text.node_id("peer", F.col("peer_ip")).alias("src"), text.node_id("asn", F.col("asn")).alias("dst"), F.lit("HOSTED_IN").alias("kind"), F.col("first_us").alias("ts_us"),
        F.lit(None).cast("long").alias("sats"), F.when(own, 1.0).otherwise(LOOKED_UP).alias("confidence"), F.when(own, "observed").otherwise("geoip").alias("evidence"),
    )


def nodes(addresses: DataFrame, tx: DataFrame, peers: DataFrame) -> DataFrame:
    """Address, transaction, peer and operator nodes with labels and spans."""
    def shape(df: DataFrame, kind: str, key: str, label: Column, first: str, last: str) -> DataFrame:
        return df.select(text.node_id(kind, F.col(key)).alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"), F.col(first).alias("first_us"), F.col(last).alias("last_us"))

    operators = peers.where(F.col("asn").isNotNull()).groupBy("asn").agg(F.min("as_org").alias("org"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    parts = [
        shape(addresses, "addr", "address", text.address_label(F.col("address")), "first_seen_us", "last_seen_us"),
        shape(tx, "tx", "txid", text.tx_label(F.col("txid")), "first_seen_us", "last_seen_us"),
        shape(peers, "peer", "peer_ip", text.ip_label(F.col("peer_ip")), "first_us", "last_us"),
        shape(operators, "asn", "asn", F.coalesce("org", F.concat(F.lit("AS"), F.col("asn").cast("string"))), "first_us", "last_us"),
    ]
    return reduce(DataFrame.unionByName, parts)


def peer_degree(edges: DataFrame) -> DataFrame:
    """(peer_ip, peer_degree): edge ends at each peer, whatever the kind and direction."""
    ends = edges.select(F.col("src").alias("n")).union(edges.select("dst")).where(F.col("n").startswith("peer:"))
    return ends.groupBy(text.bare_id(F.col("n")).alias("peer_ip")).agg(F.count(F.lit(1)).alias("peer_degree"))


def star_edges(rows: DataFrame, members: Column, evidence: str, confidence: float, keep: tuple[str, ...] = ("txid", "first_seen_us")) -> DataFrame:
    """Ownership claims from member lists: each distinct member to the smallest one.

    Lists with fewer than two distinct non-null members claim nothing; a star
    has one edge per member where a clique would have their square.
    """
    known = F.array_distinct(F.filter(members, lambda x: x.isNotNull()))
    lists = rows.select(*keep, known.alias("_m")).where(F.size("_m") >= 2)
    arms = lists.select(*keep, F.array_min("_m").alias("src"), F.explode("_m").alias("dst")).where("src <> dst")
    return arms.withColumn("confidence", F.lit(confidence)).withColumn("evidence", F.lit(evidence))


def multi_input_claims(tx: DataFrame) -> DataFrame:
    """Inputs of one transaction share an owner, mixers and coinbases aside."""
    return star_edges(tx.where(~F.col("is_coinbase") & (F.col("n_in") >= 2) & ~mixer()), F.col("input_addresses"), "multi_input", MULTI_INPUT)


def change_claims(tx: DataFrame) -> DataFrame:
    """The change output belongs to the owner of the inputs."""
    rows = tx.where(~F.col("is_coinbase") & (F.col("change_index") >= 0) & ~mixer())
    change = F.get(F.col("output_addresses"), F.col("change_index"))
    return star_edges(rows, F.concat(F.col("input_addresses"), F.array(change)), "change_addr", CHANGE)


def suppressed_claims(tx: DataFrame, rule: Column | None = None) -> DataFrame:
    """(evidence, n): claims that a rule, by default the mixer rule, suppressed."""
    mixed = tx.where((mixer() if rule is None else rule) & ~F.col("is_coinbase"))
    change = F.get(F.col("output_addresses"), F.col("change_index"))
    both = star_edges(mixed, F.col("input_addresses"), "multi_input", MULTI_INPUT).unionByName(
        star_edges(mixed.where("change_index >= 0"), F.concat(F.col("input_addresses"), F.array(change)), "change_addr", CHANGE)
    )
    return both.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"))


def strongest(claims: DataFrame) -> DataFrame:
    """One undirected edge per pair: the strongest claim, then the alphabetically first evidence."""
    pair = claims.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "confidence", "evidence", "ts_us", "txid")
    # a map-side combined minimum over (-confidence, evidence, time, txid) instead of a window
    best = pair.groupBy("src", "dst").agg(F.min(F.struct((-F.col("confidence")).alias("n"), "evidence", "ts_us", "txid")).alias("b"))
    return best.select("src", "dst", (-F.col("b.n")).alias("confidence"), "b.evidence", "b.ts_us", "b.txid")


def clusters(edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(member, root, cluster_id) over edges at or above the threshold.

    Only components of two or more members exist here; they are numbered from 0
    in the order of their smallest member.
    """
    labelled = components(edges.where(F.col("confidence") >= threshold))
    roots = labelled.select("root").distinct()
    # one small row per cluster is ranked: a range partitioning with per-range offsets
    ranged = roots.repartitionByRange("root").sortWithinPartitions("root").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = durable(ranged, "roots")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_lo"))
    before = sizes.select("_p", "_lo", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row per partition
    numbered = ranged.join(F.broadcast(before), "_p").select("root", F.concat(F.lit("cluster:"), (F.col("_before") + F.col("_i") - F.col("_lo")).cast("string")).alias("cluster_id"))
    return labelled.join(numbered, "root").select("member", "root", "cluster_id")


def cluster_facts(labelled: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per cluster: size, weakest edge and its evidence, number of heuristics."""
    sizes = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_addresses"), F.min("member").alias("first_address"))
    inside = edges.where(F.col("confidence") >= threshold).join(labelled.select(F.col("member").alias("src"), "cluster_id"), "src")
    facts = inside.groupBy("cluster_id").agg(F.min("confidence").alias("min_edge_confidence"), F.min_by("evidence", F.struct("confidence", "evidence")).alias("weakest_evidence"), F.array_sort(F.collect_set("evidence")).alias("heuristics_used"))
    return sizes.join(facts, "cluster_id")


def ledger(tx: DataFrame) -> DataFrame:
    """Every ownership claim with its transaction and the time it became known."""
    both = multi_input_claims(tx).unionByName(change_claims(tx))
    return both.select("src", "dst", "txid", F.col("first_seen_us").alias("available_us"), "confidence", "evidence").distinct()


def snapshot(claims: DataFrame, cutoff_us: int) -> DataFrame:
    """The ownership edges known at a cutoff: per pair the strongest, then the earliest claim."""
    known = claims.where(F.col("available_us") <= cutoff_us)
    pair = known.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "txid", "available_us", "confidence", "evidence")
    best = pair.groupBy("src", "dst").agg(F.min(F.struct((-F.col("confidence")).alias("n"), "available_us", "txid", "evidence")).alias("b"))
    return best.select("src", "dst", (-F.col("b.n")).alias("confidence"), "b.available_us", "b.txid", "b.evidence")


def neighbourhood(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges with at least one end among the focus nodes, by two semi-joins."""
    ids = focus.select(F.col("node_id").alias("_n")).distinct()
    a = edges.join(ids, edges["src"] == ids["_n"], "left_semi")
    b = edges.join(ids, edges["dst"] == ids["_n"], "left_semi")
    return a.unionByName(b).distinct()
