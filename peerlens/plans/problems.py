"""Queries of the general data problems (2, 4, 5, 6 and 7)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators import drift, hotkeys, instants, rejects, units
from peerlens.runtime import shared_dir, table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return units.total_in_sats(table(spark, root, "sealed"), table(spark, root, "observers"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    peers = table(spark, root, "origin_abstain").select(F.lit("peer").alias("key_kind"), "run_id", F.col("peer_ip").alias("key_value"), F.col("txid").alias("v"))
    subjects = table(spark, root, "members").select(F.lit("subject").alias("key_kind"), "run_id", F.col("subject_id").alias("key_value"), F.col("address").alias("v"))
    return hotkeys.lower_medians(peers.unionByName(subjects), ["key_kind", "run_id", "key_value"], "v")


def p4_share(spark: SparkSession, root: str) -> DataFrame:
    return hotkeys.hot_key_share(table(spark, root, "origin_abstain"), ["run_id", "peer_ip"]).select("run_id", "peer_ip", "n_rows", F.round("share", 9).alias("share"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return drift.schema_changes(table(spark, root, "capture_files"), table(spark, root, "capture_records"), table(spark, root, "header_alias"))


def p5_table(spark: SparkSession, root: str) -> DataFrame:
    rows = drift.unified_records(table(spark, root, "capture_files"), table(spark, root, "capture_records"), table(spark, root, "header_alias"))
    return rows.withColumn("other", F.to_json("other"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return instants.normalise_instants(table(spark, root, "sealed"), table(spark, root, "observers"))


def p6_increments(spark: SparkSession, root: str) -> DataFrame:
    """Problem 6 in two arrivals: the later half of the rows parses only texts that the earlier half lacked."""
    sealed, observers = table(spark, root, "sealed"), table(spark, root, "observers")
    cut = sealed.agg(F.percentile_approx("row_id", 0.5)).first()[0] or 0
    path = f"{shared_dir(spark)}/instant-dictionary-{uuid.uuid4().hex}"
    early, late = (instants.normalise_instants(sealed.where(c), observers, path) for c in (F.col("row_id") <= cut, F.col("row_id") > cut))
    return early.unionByName(late)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return rejects.rejected(table(spark, root, "capture_lines"))


def p7_loaded(spark: SparkSession, root: str) -> DataFrame:
    return rejects.loaded(table(spark, root, "capture_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p4_found, p4_share, p5_found, p5_table, p6_found, p6_increments, p7_found, p7_loaded)
}

ORACLES: dict[str, str] = {
    "p4_found": """
        WITH v AS (
          SELECT DISTINCT 'peer' AS key_kind, run_id, peer_ip AS key_value, txid AS v FROM origin_abstain
          UNION
          SELECT DISTINCT 'subject', run_id, subject_id, address FROM members),
        r AS (
          SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY key_kind, run_id, key_value) AS n
          FROM v WHERE run_id IS NOT NULL AND key_value IS NOT NULL AND v IS NOT NULL
          WINDOW w AS (PARTITION BY key_kind, run_id, key_value ORDER BY v))
        SELECT key_kind, run_id, key_value, v AS mid_value FROM r WHERE k = (n + 1) // 2""",
    "p4_share": """
        SELECT run_id, peer_ip, count(*) AS n_rows, round(count(*)::DOUBLE / (SELECT count(*) FROM origin_abstain), 9) AS share
        FROM origin_abstain GROUP BY run_id, peer_ip""",
    "p5_found": """
        WITH h AS (SELECT file_id, unnest(headers) AS header, unnest(range(len(headers))) AS pos FROM capture_files),
        s AS (SELECT *, lower(trim(replace(header, chr(65279), ''))) AS sp FROM h WHERE header IS NOT NULL),
        n AS (SELECT column_name AS sp, column_name AS col FROM header_alias UNION SELECT alias, column_name FROM header_alias),
        j AS (SELECT s.*, n.col FROM s LEFT JOIN n ON n.sp = s.sp),
        k AS (SELECT *, col IS NOT NULL AND row_number() OVER (PARTITION BY file_id, col ORDER BY pos) = 1 AS known FROM j),
        u AS (SELECT *, CASE WHEN known THEN col ELSE sp END AS column_name FROM k),
        v AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY file_id, known, column_name ORDER BY pos) = 1),
        t AS (SELECT DISTINCT r.file_id, e.key AS header, CASE WHEN e.type IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'whole' ELSE e.type END AS kind FROM capture_records r, json_each(r.record) e WHERE e.type <> 'NULL'),
        c AS (SELECT v.file_id, known, column_name, sp, kind FROM v LEFT JOIN t ON t.file_id = v.file_id AND t.header = v.header),
        f AS (SELECT feed, file_no, file_id, lag(file_id) OVER (PARTITION BY feed ORDER BY file_no) AS prev FROM capture_files),
        p AS (SELECT feed, file_no, coalesce(a.column_name, b.column_name) AS column_name, a.sp AS old_sp, b.sp AS new_sp, a.kind AS old_kind, b.kind AS new_kind
              FROM (SELECT f.feed, f.file_no, c.* FROM f JOIN c ON c.file_id = f.prev) a
              FULL JOIN (SELECT f.feed, f.file_no, c.* FROM f JOIN c ON c.file_id = f.file_id WHERE f.prev IS NOT NULL) b USING (feed, file_no, known, column_name))
        SELECT feed, file_no::BIGINT AS file_no, column_name, 'added' AS change_kind FROM p WHERE old_sp IS NULL
        UNION SELECT feed, file_no, column_name, 'removed' FROM p WHERE new_sp IS NULL
        UNION SELECT feed, file_no, column_name, 'renamed' FROM p WHERE old_sp <> new_sp
        UNION SELECT feed, file_no, column_name, 'retyped' FROM p WHERE old_kind <> new_kind""",
    "p7_found": r"""
        WITH l AS (SELECT line_id, line, regexp_full_match(',' || line, '(?:,(?:\s*"(?:[^"]|"")*"\s*|[^",]*))+') AS ok FROM capture_lines WHERE line_no <> 0 AND NOT regexp_full_match(line, '\s*')),
        x AS (SELECT line_id, ok, list_transform(regexp_extract_all(',' || line, ',(\s*"(?:[^"]|"")*"\s*|[^",]*)', 1), lambda c: regexp_replace(regexp_replace(c, '^\s*"?\s*', ''), '\s*"?\s*$', '')) AS c FROM l),
        r AS (SELECT line_id, CASE
            WHEN NOT ok THEN 'broken_quoting'
            WHEN len(c) <> 18 THEN 'wrong_column_count'
            WHEN list_contains(c[1:6], '') THEN 'missing_required_value'
            WHEN NOT regexp_full_match(c[6], '[0-9a-f]{64}') THEN 'txid_malformed'
            WHEN NOT regexp_full_match(c[1], '[0-9]+') AND NOT (regexp_full_match(c[1], '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d([.]\d+)?(Z|[+-]\d\d:?\d\d)?') AND try_cast(replace(left(c[1], 19), 'T', ' ') AS TIMESTAMP) IS NOT NULL AND substr(c[1], 12, 2) < '24') THEN 'timestamp_unparseable'
            WHEN len(list_filter([c[4], c[5], c[12], c[13], c[14], c[16]], lambda i: i <> '' AND NOT regexp_full_match(i, '[+-]?[0-9]+'))) > 0 THEN 'integer_unparseable'
            WHEN len(list_filter([c[8], c[10]], lambda i: i <> '' AND NOT regexp_full_match(i, '[0-9]+([|][0-9]+)*'))) > 0 THEN 'amount_unparseable'
            WHEN (CASE WHEN c[7] = '' THEN 0 ELSE len(string_split(c[7], '|')) END) <> (CASE WHEN c[8] = '' THEN 0 ELSE len(string_split(c[8], '|')) END) THEN 'input_length_mismatch'
            WHEN (CASE WHEN c[9] = '' THEN 0 ELSE len(string_split(c[9], '|')) END) <> (CASE WHEN c[10] = '' THEN 0 ELSE len(string_split(c[10], '|')) END) THEN 'output_length_mismatch'
            WHEN c[9] = '' THEN 'no_outputs' END AS reject_reason FROM x)
        SELECT line_id, reject_reason FROM r WHERE reject_reason IS NOT NULL""",
}

_CELLS = ORACLES["p7_found"].rsplit("SELECT line_id, reject_reason FROM r", 1)[0]
ORACLES["p7_loaded"] = _CELLS + " SELECT line_id, source_file, line_no, " + ", ".join(f"""nullif(replace(c[{i}], '""', '"'), '') AS "{c}\"""" for i, c in enumerate(rejects.COLUMNS, 1)) + " FROM x JOIN r USING (line_id) JOIN capture_lines USING (line_id) WHERE reject_reason IS NULL"
