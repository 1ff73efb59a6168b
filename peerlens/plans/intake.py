"""Queries of the intake operators over the loaded capture lines."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators import asof, intake, ordered, rejects
from peerlens.operators.rejects import COLUMNS
from peerlens.plans import problems
from peerlens.runtime import durable, shared_dir, table
from peerlens.sources import capture, sinks
from peerlens.sources.capture import LISTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rows(spark: SparkSession, root: str) -> DataFrame:
    """Loaded lines as an intake sees them: list columns split, blank lists empty."""
    good = rejects.loaded(table(spark, root, "capture_lines"))
    shape = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, r"\|")) if c in LISTS else F.col(c)
    return good.select("line_id", *[shape(c).alias(c) for c in COLUMNS])


def coerced(spark: SparkSession, root: str) -> DataFrame:
    return intake.coerce(rows(spark, root), "sats", "iso")


# Cells of the loaded lines, by the twin of problem 7.
CELLS = problems.ORACLES["p7_found"].rsplit("SELECT line_id, reject_reason FROM r", 1)[0] + ", good AS (SELECT x.line_id, c FROM x JOIN r USING (line_id) WHERE reject_reason IS NULL)"
_AMOUNTS = """, t AS (SELECT 'input_amounts' AS "column", unnest(string_split(c[8], '|')) AS t FROM good UNION ALL SELECT 'output_amounts', unnest(string_split(c[10], '|')) FROM good)"""


@query(CELLS + _AMOUNTS + """ SELECT "column", count(*) FILTER (regexp_full_match(t, '[0-9]+')) AS n_int, count(*) FILTER (regexp_full_match(t, '[0-9]+\\.[0-9]+')) AS n_dec,
    count(*) FILTER (NOT regexp_full_match(t, '[0-9]+(\\.[0-9]+)?')) AS n_junk FROM t WHERE t <> '' GROUP BY "column\"""")
def val01_amount_shapes(spark: SparkSession, root: str) -> DataFrame:
    return intake.amount_shapes(rows(spark, root))


@query("""WITH t AS (SELECT row_id, unnest(output_amounts) AS t FROM sealed)
    SELECT row_id, count(*) AS n, (sum(CASE WHEN regexp_full_match(t, '[0-9]+\\.[0-9]+') AND (t::DECIMAL(28,10) * 100000000) % 1 = 0 THEN (t::DECIMAL(28,10) * 100000000)::BIGINT END))::BIGINT AS sats
    FROM t WHERE t IS NOT NULL GROUP BY row_id""")
def val02_btc_to_sats(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "sealed").select("row_id", F.explode("output_amounts").alias("t")).where("t is not null")
    return t.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.sum(intake.sats(F.col("t"), "btc")).alias("sats"))


@query("""SELECT source_file, CASE WHEN NOT bool_and(regexp_full_match(c, '-?[0-9]+')) THEN 'iso' WHEN max(length(ltrim(c, '-'))) >= 15 THEN 'us' WHEN max(length(ltrim(c, '-'))) >= 12 THEN 'ms' ELSE 's' END AS clock
    FROM (SELECT source_file, trim(split_part(line, ',', 1), ' "') AS c FROM capture_lines WHERE line_no > 0 AND line IS NOT NULL) WHERE c <> '' GROUP BY source_file""")
def val03_clock_of_each_file(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "capture_lines").where("line_no > 0 and line is not null").select("source_file", F.expr("trim(BOTH ' \"' FROM substring_index(line, ',', 1))").alias("timestamp"))
    return intake.clocks(lines, ["source_file"])


_ISO = "regexp_full_match(c[1], '[0-9]+')"
_SUM = "coalesce(list_sum(list_transform(list_filter(string_split(c[{}], '|'), lambda x: x <> ''), lambda x: x::BIGINT)), 0)"


@query(CELLS + f""", v AS (SELECT line_id, c, CASE WHEN {_ISO} THEN CASE WHEN length(c[1]) <= 18 THEN try_cast(c[1]::HUGEINT * 1000000 AS BIGINT) END
        ELSE epoch_us(try_cast(replace(left(c[1], 19), 'T', ' ') AS TIMESTAMP)) + coalesce(rpad(nullif(regexp_extract(c[1], '[.]([0-9]{{1,6}})', 1), ''), 6, '0')::BIGINT, 0)
          - coalesce(CASE WHEN regexp_matches(c[1], '[+-][0-9][0-9]:?[0-9][0-9]$') THEN (CASE WHEN regexp_matches(c[1], '-[0-9][0-9]:?[0-9][0-9]$') THEN -1 ELSE 1 END)
            * (regexp_extract(c[1], '[+-]([0-9][0-9]):?[0-9][0-9]$', 1)::BIGINT * 60 + right(c[1], 2)::BIGINT) * 60000000 END, 0) END AS ts_us FROM good)
    SELECT line_id, ts_us, try_cast(nullif(c[13], '') AS BIGINT) AS fee_sats, regexp_matches(c[1], '[T ][0-9:.,]+$') AS naive,
      CASE WHEN ts_us IS NULL THEN 'timestamp_unparseable' WHEN c[7] <> '' AND {_SUM.format(8)} < {_SUM.format(10)} THEN 'value_not_conserved' END AS reject_reason FROM v""")
def val04_05_coerce(spark: SparkSession, root: str) -> DataFrame:
    """Typed rows with the instant, the fee and the first failure of each."""
    return coerced(spark, root).select("line_id", "ts_us", F.col("_fee_sats").alias("fee_sats"), "naive", "reject_reason")


@query("SELECT ip, CASE WHEN ip LIKE '%:%' THEN 6 ELSE 4 END::BIGINT AS version FROM (SELECT src_ip AS ip FROM sealed WHERE src_ip IS NOT NULL UNION SELECT dst_ip FROM sealed WHERE dst_ip IS NOT NULL)")
def val07_ip_version(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "sealed")
    ips = s.select(F.col("src_ip").alias("ip")).union(s.select("dst_ip")).where("ip is not null").distinct()
    return ips.select("ip", F.when(asof.ip_key(F.col("ip")).startswith("4"), 4).when(asof.ip_key(F.col("ip")).startswith("6"), 6).cast("long").alias("version"))


_T = "input_addresses, output_addresses, input_amounts, output_amounts, fee_sats, vsize, script_types, block_height"


@query(f"SELECT txid FROM (SELECT DISTINCT txid, {_T} FROM sealed) GROUP BY txid HAVING count(*) > 1")
def val08_disagreeing(spark: SparkSession, root: str) -> DataFrame:
    return intake.disagreeing(table(spark, root, "sealed"))


@query("SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM sealed)))::BIGINT AS n_duplicates FROM sealed")
def val09_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return intake.duplicates(table(spark, root, "sealed"))


@query(problems.ORACLES["p7_found"].rsplit("SELECT line_id, reject_reason FROM r", 1)[0] + " SELECT reject_reason, count(*) AS n FROM r GROUP BY reject_reason")
def val10_13_accounting(spark: SparkSession, root: str) -> DataFrame:
    """Read, loaded and rejected rows by reason; the reasons add up to all rows."""
    lines = rejects.reject_lines(table(spark, root, "capture_lines"))
    return intake.accounting(lines.select("reject_reason"))


_SHOWN = ("timestamp", "src_ip", "dst_port", "txid", "geo_country", "fee_sats", "observer_id")
_JOINED = ("input_addresses", "output_amounts", "script_types")


@query("SELECT kind, line_id, " + ", ".join(f'"{c}"' for c in _SHOWN) + ", " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _JOINED) + f""" FROM (
    SELECT *, row_number() OVER (ORDER BY source_file, line_no, line_id) - 1 AS row_id FROM ({problems.ORACLES["p7_loaded"]})), (SELECT unnest(['csv', 'jsonl', 'xml']) AS kind)""")
def src01_07_captures(spark: SparkSession, root: str) -> DataFrame:
    """The loaded lines exported as CSV, JSON Lines and XML files and read again by content; the order of rows is the files'."""
    good = rejects.loaded(table(spark, root, "capture_lines"))
    shape = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, r"\|")) if c in LISTS else F.col(c)
    order = ["source_file", "line_no", "line_id"]
    ranged = durable(good.select(*order, *[shape(c).alias(c) for c in COLUMNS]).repartitionByRange(4, *order).sortWithinPartitions(*order), "export")
    ids = ordered.running_total(ranged.select(*order, F.lit(1).cast("long").alias("one")), [], [F.col(c).asc() for c in order], "one", "upto").select("line_id", (F.col("upto") - 1).alias("row_id"))
    home, parts = f"{shared_dir(spark)}/captures-{uuid.uuid4().hex}", []
    for kind, export in (("csv", sinks.export_csv), ("jsonl", sinks.export_jsonl), ("xml", sinks.export_xml)):
        export(ranged.orderBy(*order).select(*COLUMNS), f"{home}/{kind}")
        rows = capture.read_capture(spark, f"{home}/{kind}")
        parts.append(rows.join(ids, "row_id").select(F.lit(kind).alias("kind"), "line_id", *_SHOWN, *[F.array_join(c, "|").alias(c) for c in _JOINED]))
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT column_name, count(*) AS n_files, (SELECT count(*) FROM capture_files) AS n_all FROM (SELECT DISTINCT file_id, coalesce(own.column_name, al.column_name) AS column_name FROM
    (SELECT file_id, lower(trim(replace(unnest(headers), chr(65279), ''))) AS h FROM capture_files) f LEFT JOIN (SELECT DISTINCT column_name FROM header_alias) own ON own.column_name = h LEFT JOIN header_alias al ON al.alias = h)
    WHERE column_name IS NOT NULL GROUP BY column_name""")
def val11_src08_mapped_columns(spark: SparkSession, root: str) -> DataFrame:
    """In how many files each known column is mapped."""
    from peerlens.operators.drift import resolved_headers

    files = table(spark, root, "capture_files")
    known = resolved_headers(files, table(spark, root, "header_alias")).where("known").groupBy("column_name").agg(F.count(F.lit(1)).alias("n_files"))
    return known.join(F.broadcast(files.agg(F.count(F.lit(1)).alias("n_all"))))


@query("SELECT line_id, (row_number() OVER (ORDER BY source_file, line_no) - 1) AS row_id FROM capture_lines WHERE line_no > 0")
def val12_row_ids(spark: SparkSession, root: str) -> DataFrame:
    """0-based row numbers across the files in name order, by running totals over ranges: neither a file nor the whole sits in one task."""
    lines = table(spark, root, "capture_lines").where("line_no > 0").select("line_id", "source_file", "line_no", F.lit(1).cast("long").alias("one"))
    placed = ordered.running_total(lines, [], [F.col("source_file").asc(), F.col("line_no").asc()], "one", "upto")
    return placed.select("line_id", (F.col("upto") - 1).alias("row_id"))
