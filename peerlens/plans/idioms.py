"""Queries of the expression-level operators: projections, arrays, joins, aggregates, windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.functions import arrays, stats, text
from peerlens.operators import evaluate
from peerlens.operators.ordered import exact_medians, running_total
from peerlens.plans import base
from peerlens.runtime import table
from peerlens.sources import capture, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query("""SELECT row_id AS id, src_ip AS peer_ip, NULL::VARCHAR AS extra, CASE WHEN fee_sats IS NULL THEN 'none' WHEN fee_sats < 1000 THEN 'low' WHEN fee_sats < 10000 THEN 'mid' ELSE 'high' END AS fee_band,
    coalesce(geo_country, '??') AS country, least(fee_sats, vsize)::BIGINT AS lo, greatest(fee_sats, vsize)::BIGINT AS hi, greatest(fee_sats - 5000, 0)::BIGINT AS clipped,
    coalesce(msg_type = 'inv', false) AS is_inv, fee_sats BETWEEN 1000 AND 9000 AS between_, (asn IS NOT NULL AND geo_country IS NOT NULL) AS all_set, (asn IS NULL OR geo_country IS NULL) AS any_null,
    coalesce(CASE src_ip_version WHEN 4 THEN 'v4' WHEN 6 THEN 'v6' END, 'unknown') AS family FROM sealed""")
def prj01_12_projection(spark: SparkSession, root: str) -> DataFrame:
    """PRJ-01 to 06 and 08 to 12: select, typed null, branches, coalesce, row-wise extremes and predicates, lookups, clips, structs."""
    s = table(spark, root, "sealed")
    fee = F.col("fee_sats")
    lookup = F.create_map(F.lit(4), F.lit("v4"), F.lit(6), F.lit("v6"))
    nested = s.withColumn("where", F.struct("geo_country", "asn"))
    return nested.select(
        F.col("row_id").alias("id"), F.col("src_ip").alias("peer_ip"), F.lit(None).cast("string").alias("extra"),
        F.when(fee.isNull(), "none").when(fee < 1000, "low").when(fee < 10000, "mid").otherwise("high").alias("fee_band"), F.coalesce("where.geo_country", F.lit("??")).alias("country"),
        F.least("fee_sats", "vsize").cast("long").alias("lo"), F.greatest("fee_sats", "vsize").cast("long").alias("hi"), F.greatest(fee - 5000, F.lit(0)).alias("clipped"),
        F.coalesce(F.col("msg_type") == "inv", F.lit(False)).alias("is_inv"), fee.between(1000, 9000).alias("between_"),
        (F.col("where.asn").isNotNull() & F.col("where.geo_country").isNotNull()).alias("all_set"), (F.col("where.asn").isNull() | F.col("where.geo_country").isNull()).alias("any_null"),
        F.coalesce(F.try_element_at(lookup, F.col("src_ip_version").cast("int")), F.lit("unknown")).alias("family"),
    )


@query("SELECT edge_id FROM edges WHERE kind IN ('SAME_OWNER', 'SHARED_PEER') AND a IN (SELECT unnest(addresses) FROM clusters)")
def prj07_membership(spark: SparkSession, root: str) -> DataFrame:
    members = table(spark, root, "clusters").select(F.explode("addresses").alias("a")).distinct()
    return table(spark, root, "edges").where(F.col("kind").isin("SAME_OWNER", "SHARED_PEER")).join(members, "a", "left_semi").select("edge_id")


@query("""SELECT run_id, txid, peer_ip, as_org, NULL::VARCHAR AS estimator, 'abstain' AS origin FROM origin_abstain
    UNION ALL SELECT NULL, txid, peer_ip, NULL, estimator, 'estimate' FROM origin_estimates""")
def prj13_union_by_name(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "origin_abstain").select("run_id", "txid", "peer_ip", "as_org", F.lit("abstain").alias("origin"))
    b = table(spark, root, "origin_estimates").select("txid", "peer_ip", "estimator", F.lit("estimate").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT cluster_id, row_number() OVER (PARTITION BY threshold ORDER BY n_addresses DESC, cluster_id) AS i, left(sha256(cluster_id), 12) AS h FROM clusters")
def prj14_15_row_index_and_hash(spark: SparkSession, root: str) -> DataFrame:
    w = Window.partitionBy("threshold").orderBy(F.desc("n_addresses"), "cluster_id")
    return table(spark, root, "clusters").select("cluster_id", F.row_number().over(w).cast("long").alias("i"), text.hash_id(F.col("cluster_id"), 12).alias("h"))


@query(f"""WITH {base.TX} SELECT txid, len(output_addresses)::BIGINT AS n, coalesce(list_sum(output_amounts), CASE WHEN output_amounts IS NULL THEN NULL ELSE 0 END)::BIGINT AS total, list_min(output_amounts) AS lo, list_max(output_amounts) AS hi,
    output_addresses[1] AS first_, output_addresses[n_out + 5] AS beyond, len(list_distinct(output_amounts)) < len(output_amounts) AS repeats,
    (list_position(output_amounts, list_max(output_amounts)) - 1)::BIGINT AS at_max, list_contains(output_addresses, input_addresses[1]) AS pays_self,
    array_to_string(list_sort(list_distinct(list_concat(input_addresses, output_addresses))), ',') AS everyone, list_min(list_concat(input_addresses, output_addresses)) AS anchor,
    len(list_filter(output_amounts, lambda x: x BETWEEN 90000 AND 99999)) > 0 AS banded FROM tx""")
def arr01_09_arrays(spark: SparkSession, root: str) -> DataFrame:
    """ARR-03 to ARR-09: sizes, sums, extremes, positions, membership, distinct, element predicates."""
    t = base.tx(spark, root)
    both = F.concat("input_addresses", "output_addresses")
    amounts = F.col("output_amounts")
    return t.select(
        "txid", F.size("output_addresses").cast("long").alias("n"), arrays.total(amounts).alias("total"), F.array_min(amounts).alias("lo"), F.array_max(amounts).alias("hi"),
        F.get("output_addresses", F.lit(0)).alias("first_"), F.get("output_addresses", F.col("n_out") + 4).alias("beyond"), arrays.has_repeats(amounts).alias("repeats"),
        F.when(amounts.isNotNull(), arrays.arg_max(amounts)).cast("long").alias("at_max"), F.when(F.size("input_addresses") > 0, arrays.contains(F.col("output_addresses"), F.get("input_addresses", F.lit(0)))).alias("pays_self"),
        F.array_join(F.array_sort(F.array_distinct(both)), ",").alias("everyone"), F.array_min(both).alias("anchor"), F.exists(amounts, lambda x: x.between(90000, 99999)).alias("banded"),
    )


@query(f"WITH {base.TX} SELECT txid, unnest(output_addresses) AS address, unnest(range(len(output_addresses)))::BIGINT AS pos FROM tx")
def arr02_positional_explode(spark: SparkSession, root: str) -> DataFrame:
    return _long(base.tx(spark, root).select("txid", F.posexplode("output_addresses").alias("pos", "address")), "pos")


@query("SELECT run_id, subject_id, string_agg(DISTINCT address, ',' ORDER BY address) AS addresses FROM members WHERE subject_id IS NOT NULL GROUP BY run_id, subject_id")
def arr10_sorted_lists(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "members").where("subject_id is not null")
    return m.groupBy("run_id", "subject_id").agg(F.array_join(F.array_sort(F.collect_set("address")), ",").alias("addresses"))


@query(f"""WITH {base.SIDES}, g AS (SELECT address, at_us - lag(at_us) OVER (PARTITION BY address ORDER BY at_us, txid, side) AS gap FROM sides WHERE at_us IS NOT NULL)
    SELECT address, round(avg(gap) / 3.6e9, 6) AS mean_gap, round(stddev_samp(gap) / 3.6e9, 6) AS std_gap FROM g GROUP BY address HAVING count(gap) > 1""")
def arr11_gaps(spark: SparkSession, root: str) -> DataFrame:
    from peerlens.operators.normalise import sides

    w = Window.partitionBy("address").orderBy("at_us", "txid", "side")
    g = sides(base.tx(spark, root)).where("at_us is not null").withColumn("gap", F.col("at_us") - F.lag("at_us").over(w))
    return g.groupBy("address").agg(F.round(F.avg("gap") / 3.6e9, 6).alias("mean_gap"), F.round(F.stddev_samp("gap") / 3.6e9, 6).alias("std_gap"), F.count("gap").alias("n")).where("n > 1").drop("n")


@query("""SELECT row_id, CASE WHEN src_ip LIKE '%:%' THEN split_part(src_ip, ':', 1) || ':' || split_part(src_ip, ':', 2) || ':x:x' ELSE split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2) || '.x.x' END AS ip_label,
    left(txid, 8) || '…' || right(txid, 4) AS tx_label, 'peer:' || src_ip AS node, src_ip AS bare, len(string_split(src_ip, '.'))::BIGINT AS n_parts, (length(src_ip) - length(replace(src_ip, '.', '')))::BIGINT AS n_dots,
    lower(msg_type) AS msg, array_to_string(output_addresses, '|') AS joined, CASE WHEN length(txid || msg_type) >= 68 THEN left(txid || msg_type, 64) || '...' ELSE txid || msg_type END AS prose FROM sealed""")
def str01_07_strings(spark: SparkSession, root: str) -> DataFrame:
    """STR-02 to STR-07: prefixes, labels, counts, splits, case, truncation."""
    s = table(spark, root, "sealed")
    line = F.concat("txid", "msg_type")
    node = text.node_id("peer", F.col("src_ip"))
    return s.select(
        "row_id", text.ip_label(F.col("src_ip")).alias("ip_label"), text.tx_label(F.col("txid")).alias("tx_label"), node.alias("node"), text.bare_id(node).alias("bare"),
        F.size(F.split("src_ip", r"\.")).cast("long").alias("n_parts"), F.regexp_count("src_ip", F.lit(r"\.")).cast("long").alias("n_dots"), F.lower("msg_type").alias("msg"), F.array_join("output_addresses", "|").alias("joined"),
        F.when(F.char_length(line) >= 68, F.concat(F.substring(line, 1, 64), F.lit("..."))).otherwise(line).alias("prose"),
    )


@query(f"""WITH {base.TX} SELECT txid, round(ln(1 + fee_sats), 9) AS log_fee, round(exp(-fee_rate_sat_vb / 100), 9) AS decay, round(sqrt(n_out), 9) AS root_, abs(coalesce(total_in_sats, 0) - coalesce(total_out_sats, 0))::BIGINT AS gap,
    total_out_sats % 1000 = 0 AS is_round, list_min(output_amounts) * 20 <= total_out_sats * 7 AS small_pay, round(0.5 * pow(0.5, n_in), 9) AS halved FROM tx""")
def mth01_04_math(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return t.select(
        "txid", F.round(F.log1p("fee_sats"), 9).alias("log_fee"), F.round(F.exp(-F.col("fee_rate_sat_vb") / 100), 9).alias("decay"), F.round(F.sqrt("n_out"), 9).alias("root_"),
        F.abs(z("total_in_sats") - z("total_out_sats")).alias("gap"), (F.col("total_out_sats") % 1000 == 0).alias("is_round"),
        (F.array_min("output_amounts") * 20 <= F.col("total_out_sats") * 7).alias("small_pay"), F.round(0.5 * F.pow(F.lit(0.5), F.col("n_in")), 9).alias("halved"),
    )


@query("""SELECT row_id, strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') AS at, ((ts_us // 3600000000) % 24)::BIGINT AS hour FROM sealed WHERE ts_us IS NOT NULL""")
def tim01_02_time(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "sealed").where("ts_us is not null")
    return s.select("row_id", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.expr("cast((ts_us div 3600000000) % 24 as bigint)").alias("hour"))


@query("SELECT edge_id, left(sha256(kind || ':' || txid), 16) AS hit_id, 'alw-' || left(sha256(a || ':42'), 12) AS alert_id FROM edges")
def hsh01_ids(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "edges")
    return e.select("edge_id", text.hash_id(F.concat("kind", F.lit(":"), "txid")).alias("hit_id"), text.hash_id(F.concat("a", F.lit(":42")), 12, "alw-").alias("alert_id"))


@query("""SELECT n_nationkey, r_name, count(*) AS n_customers, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_nationkey, r_name""")
def joi01_inner(spark: SparkSession, root: str) -> DataFrame:
    c, n, r = (table(spark, root, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return _long(j.groupBy("n_nationkey", "r_name").agg(F.count(F.lit(1)).alias("n_customers"), F.sum(_cents("c_acctbal")).alias("cents")), "n_nationkey")


@query("SELECT o_orderkey, o_custkey, c_name, l_cents FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS l_cents FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def joi02_left(spark: SparkSession, root: str) -> DataFrame:
    o, c, li = (table(spark, root, t) for t in ("orders", "customer", "lineitem"))
    spent = li.groupBy("l_orderkey").agg(F.sum(_cents("l_extendedprice")).alias("l_cents"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(spent, o["o_orderkey"] == spent["l_orderkey"], "left")
    return _long(j.select("o_orderkey", "o_custkey", "c_name", "l_cents"), "o_orderkey", "o_custkey")


@query("SELECT coalesce(a.peer_ip, b.peer_ip) AS peer_ip, n_short, n_est FROM (SELECT peer_ip, count(*) AS n_short FROM origin_abstain WHERE peer_ip IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT peer_ip, count(*) AS n_est FROM origin_estimates WHERE peer_ip IS NOT NULL GROUP BY 1) b ON a.peer_ip = b.peer_ip")
def joi03_full(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "origin_abstain").where("peer_ip is not null").groupBy("peer_ip").agg(F.count(F.lit(1)).alias("n_short"))
    b = table(spark, root, "origin_estimates").where("peer_ip is not null").groupBy("peer_ip").agg(F.count(F.lit(1)).alias("n_est"))
    return a.join(b, "peer_ip", "full")


@query("SELECT 'semi' AS how, c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def joi04_05_semi_anti(spark: SparkSession, root: str) -> DataFrame:
    c, o = table(spark, root, "customer"), table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    part = lambda how: c.join(o, "c_custkey", f"left_{how}").select(F.lit(how).alias("how"), F.col("c_custkey").cast("long").alias("k"))
    return part("semi").unionByName(part("anti"))


@query("""SELECT peer_ip, count(*) AS n, count(p_origin) AS n_p, count(DISTINCT txid) AS n_tx, count(DISTINCT asn) + max((asn IS NULL)::INT) AS n_asn, count(*) FILTER (rank <= 3) AS n_top, round(avg((rank <= 3)::INT), 9) AS share_top,
    min(first_seen_us) AS lo, max(first_seen_us) AS hi, arg_min(asn, row_id) FILTER (asn IS NOT NULL) AS first_asn, trunc(median(first_seen_us))::BIGINT AS mid, bool_or(net_class = 'tor') AS any_tor, bool_and(rank > 1) AS no_first,
    count(DISTINCT txid) FILTER (rank <= 3) AS n_tx_top, 2 * sum((rank <= 3)::INT) > count(*) AS mostly_top FROM origin_abstain WHERE peer_ip IS NOT NULL GROUP BY peer_ip""")
def agg01_15_aggregates(spark: SparkSession, root: str) -> DataFrame:
    """AGG-01 to 05, 08, 13 and 15 in one grouping."""
    top = F.col("rank") <= 3
    g = table(spark, root, "origin_abstain").where("peer_ip is not null").groupBy("peer_ip").agg(
        F.count(F.lit(1)).alias("n"), F.count("p_origin").alias("n_p"), F.count_distinct("txid").alias("n_tx"), stats.distinct_with_null(F.col("asn")).cast("long").alias("n_asn"), F.count_if(top).alias("n_top"),
        F.round(stats.share(top), 9).alias("share_top"), F.min("first_seen_us").alias("lo"), F.max("first_seen_us").alias("hi"), stats.first_by(F.col("asn"), F.col("row_id")).cast("long").alias("first_asn"),
        stats.truncated_median(F.col("first_seen_us")).alias("mid"), F.bool_or(F.col("net_class") == "tor").alias("any_tor"), F.bool_and(F.col("rank") > 1).alias("no_first"),
        F.count_distinct(F.when(top, F.col("txid"))).alias("n_tx_top"), stats.majority(top).alias("mostly_top"),
    )
    return g


@query("""SELECT estimator, quantile_disc(p_origin, 0.5) AS p50, quantile_disc(p_origin, 0.99) AS p99, round(stddev_samp(p_origin), 9) AS std, round(stddev_samp(p_origin) / nullif(avg(p_origin), 0), 9) AS cv
    FROM origin_estimates WHERE p_origin IS NOT NULL AND NOT isnan(p_origin) GROUP BY estimator""")
def agg06_07_quantiles(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "origin_estimates").where(F.col("p_origin").isNotNull() & ~F.isnan("p_origin"))
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY p_origin)")
    return e.groupBy("estimator").agg(disc(0.5).alias("p50"), disc(0.99).alias("p99"), F.round(F.stddev_samp("p_origin"), 9).alias("std"), F.round(stats.variation(F.col("p_origin")), 9).alias("cv"))


@query(f"WITH {base.TX} SELECT txid, fee_rate_sat_vb - (SELECT median(fee_rate_sat_vb) FROM tx) AS dev FROM tx")
def agg10_scalar_reuse(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root)
    # the median by running totals over ranges, so no task holds all values; one row
    return t.join(F.broadcast(exact_medians(t, [], "fee_rate_sat_vb", "m"))).select("txid", (F.col("fee_rate_sat_vb") - F.col("m")).alias("dev"))


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT run_id, subject_id, address, start_us, end_us, partition_mode FROM members)) AS n_distinct, (SELECT count(*) FROM (SELECT DISTINCT txid, estimator, peer_ip FROM origin_estimates)) AS n_keys FROM members")
def agg11_distinct(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "members")
    keys = table(spark, root, "origin_estimates").dropDuplicates(["txid", "estimator", "peer_ip"]).agg(F.count(F.lit(1)).alias("n_keys"))
    return m.agg(F.count(F.lit(1)).alias("n_rows")).join(m.distinct().agg(F.count(F.lit(1)).alias("n_distinct"))).join(keys)


@query("SELECT n_announcements AS k, count(*) AS n FROM (SELECT txid, count(*) AS n_announcements FROM sealed GROUP BY txid) GROUP BY 1")
def agg14_histogram(spark: SparkSession, root: str) -> DataFrame:
    per_tx = table(spark, root, "sealed").groupBy("txid").agg(F.count(F.lit(1)).alias("c"))
    return evaluate.histogram(per_tx, F.col("c"), "k")


@query("""SELECT event_id, rank() OVER w AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS delta,
    count(*) OVER (PARTITION BY user_id) AS n, (sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run_cents,
    epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap,
    nth_value(event_id, 1) OVER f AS leader, nth_value(event_id, 2) OVER f AS runner, coalesce(value, min(value) OVER (PARTITION BY user_id), 0) AS filled
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type), f AS (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win01_10_windows(spark: SparkSession, root: str) -> DataFrame:
    """WIN-01 to WIN-10: ranks, ordinals, deltas, partition totals, running sums, gaps, leader and runner-up, fills."""
    e = table(spark, root, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    u = Window.partitionBy("user_id")
    o = u.orderBy("us", "event_id")
    f = u.orderBy(F.desc("value"), "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.select(
        F.col("event_id").cast("long").alias("event_id"), F.rank().over(u.orderBy("event_type")).cast("long").alias("r"), F.row_number().over(o).cast("long").alias("rn"), (F.col("us") - F.min("us").over(u)).alias("delta"),
        F.count(F.lit(1)).over(u).alias("n"), F.sum(_cents("value")).over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("run_cents"), (F.col("us") - F.lag("us").over(o)).alias("gap"),
        F.nth_value("event_id", 1).over(f).cast("long").alias("leader"), F.nth_value("event_id", 2).over(f).cast("long").alias("runner"), F.coalesce("value", F.min("value").over(u), F.lit(0.0)).alias("filled"),
    )


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def srt01_05_sort_page(spark: SparkSession, root: str) -> DataFrame:
    """SRT-01, 04 and 05: a totally ordered page."""
    page = table(spark, root, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)
    w = Window.orderBy(F.desc("o_totalprice"), "o_orderkey")  # over the twenty rows of the page
    return page.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), (F.row_number().over(w) + 40).cast("long").alias("place"))


@query("SELECT row_id, asn FROM sealed ORDER BY asn DESC NULLS LAST, row_id LIMIT 50")
def srt02_nulls_last(spark: SparkSession, root: str) -> DataFrame:
    return _long(table(spark, root, "sealed").orderBy(F.col("asn").desc_nulls_last(), "row_id").limit(50).select("row_id", "asn"), "asn")


@query(f"""WITH {base.TX}, t AS (SELECT txid, row_number() OVER (ORDER BY first_seen_us, txid) AS i, count(*) OVER () AS n FROM tx WHERE first_seen_us IS NOT NULL)
    SELECT txid, CASE WHEN i <= floor(n * 0.75) THEN 'train' ELSE 'rest' END AS part FROM t""")
def srt03_time_split(spark: SparkSession, root: str) -> DataFrame:
    t = base.tx(spark, root).where("first_seen_us is not null").select("txid", "first_seen_us")
    return evaluate.split_by_time(t, ["first_seen_us", "txid"], 0.75).select("txid", "part")


@query("SELECT block_height, n FROM (SELECT *, row_number() OVER (ORDER BY block_height) AS i FROM (SELECT block_height, count(*) AS n FROM sealed WHERE block_height IS NOT NULL GROUP BY 1)) WHERE (i - 1) % 3 = 0")
def srt06_downsample(spark: SparkSession, root: str) -> DataFrame:
    """Every third point of the block series; the series has one row per block."""
    series = table(spark, root, "sealed").where("block_height is not null").groupBy("block_height").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(series.withColumn("one", F.lit(1).cast("long")), [], [F.col("block_height").asc()], "one", "i")
    return _long(placed.where("(i - 1) % 3 = 0").select("block_height", "n"), "block_height")


@query("""SELECT 'union' AS op, peer_ip AS k FROM (SELECT peer_ip FROM origin_abstain UNION SELECT peer_ip FROM origin_estimates) UNION ALL SELECT 'common', peer_ip FROM (SELECT peer_ip FROM origin_abstain INTERSECT SELECT peer_ip FROM origin_estimates)
    UNION ALL SELECT 'only', peer_ip FROM (SELECT peer_ip FROM origin_estimates EXCEPT SELECT peer_ip FROM origin_abstain)""")
def set01_03_sets(spark: SparkSession, root: str) -> DataFrame:
    a, b = table(spark, root, "origin_abstain").select(F.col("peer_ip").alias("k")), table(spark, root, "origin_estimates").select(F.col("peer_ip").alias("k"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "common")).unionByName(tag(b.subtract(a), "only"))


@query(f"""WITH {base.TX} SELECT txid, round(len(list_intersect(list_distinct(input_addresses), list_distinct(output_addresses)))::DOUBLE / nullif(len(list_distinct(list_concat(input_addresses, output_addresses))), 0), 9) AS overlap FROM tx""")
def set04_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return base.tx(spark, root).select("txid", F.round(arrays.jaccard(F.col("input_addresses"), F.col("output_addresses")), 9).alias("overlap"))


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'de'")
def src09_projected_scan(spark: SparkSession, root: str) -> DataFrame:
    return _long(table(spark, root, "documents").where("lang = 'de'").select("doc_id", "n_chars"), "n_chars")


@query("SELECT 'sealed' AS name, count(*) AS n FROM sealed UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'documents', count(*) FROM documents")
def src10_counts(spark: SparkSession, root: str) -> DataFrame:
    parts = [table(spark, root, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("sealed", "edges", "documents")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT geo_country, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM sealed), 9) AS share FROM sealed GROUP BY 1 ORDER BY n DESC, geo_country NULLS FIRST LIMIT 10")
def src16_peek(spark: SparkSession, root: str) -> DataFrame:
    return capture.peek(table(spark, root, "sealed"), "geo_country", 10).withColumn("share", F.round("share", 9))


@query("SELECT edge_id, sats::INT AS sats, confidence::FLOAT::DOUBLE AS confidence FROM (SELECT edge_id, CASE WHEN sats BETWEEN -2147483648 AND 2147483647 THEN sats END AS sats, confidence FROM edges)")
def snk00_conform(spark: SparkSession, root: str) -> DataFrame:
    out = sinks.conform(table(spark, root, "edges"), {"edge_id": "bigint", "sats": "int", "confidence": "float"})
    return out.withColumn("confidence", F.col("confidence").cast("double")).withColumn("sats", F.col("sats").cast("long"))
