"""Writers: ordered parquet with a canonical row digest, lineage records, capture exports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.sources.capture import LISTS


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of a contract, in order, cast without failing; a missing column is an error."""
    if lost := [c for c in schema if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in schema.items()])


def row_digest(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order, partitioning and file names.

    The SHA-256 of every row's canonical JSON is summed in two halves; equal
    multisets of rows have equal sums, and repeated rows count.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)"))
    r = df.agg(F.count(F.lit(1)), F.coalesce(half(1), F.lit(0)), F.coalesce(half(13), F.lit(0))).first()
    return hashlib.sha256(":".join(map(str, r)).encode()).hexdigest()


def write_table(df: DataFrame, path: str, order: list[str]) -> str:
    """Parquet sorted by ``order`` across files, zstd; returns the row digest."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return row_digest(df.sparkSession.read.parquet(path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any Hadoop file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def lineage(spark: SparkSession, path: str, stage: str, params: dict, inputs: dict[str, str], outputs: dict[str, str], counts: dict[str, int], warnings: list[str]) -> dict:
    """A stage's ``_meta.json``; what came in must be what went out or was dropped."""
    if counts["in"] != counts["out"] + counts["dropped"]:
        raise ValueError("counts do not add up")
    record = {"stage": stage, "params": params, "inputs": inputs, "outputs": outputs, "counts": counts, "warnings": warnings}
    write_text(spark, path, json.dumps(record, sort_keys=True, indent=1))
    return record


# What of a manifest depends on the clock and not on the data.
CLOCKED = ("sealed_at", "took_s", "manifest_sha256")


def manifest_hash(record: dict) -> str:
    """Digest of a manifest without the fields that depend on the clock."""
    kept = {k: v for k, v in record.items() if k not in CLOCKED}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest(spark: SparkSession, folder: str, hashes: DataFrame, facts: dict, clock: dict) -> dict:
    """``INPUT.sha256`` and ``manifest.json`` of a sealed capture; ``hashes`` is one row per input file."""
    files = [r.asDict() for r in hashes.orderBy("name").collect()]
    write_text(spark, f"{folder}/INPUT.sha256", "".join(f"{f['sha256']}  {f['name']}\n" for f in files))
    record = {**facts, **clock, "inputs": files}
    record["manifest_sha256"] = manifest_hash(record)
    write_text(spark, f"{folder}/manifest.json", json.dumps(record, sort_keys=True, indent=1))
    return record


def export_csv(df: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    """CSV shards with lists joined by bars."""
    flat = df.select(*[F.array_join(c, "|").alias(c) if c in LISTS else F.col(c) for c in df.columns])
    flat.write.option("maxRecordsPerFile", rows_per_file).csv(path, header=True, quote='"', escape='"')


def export_jsonl(df: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", False).json(path)


def export_xml(df: DataFrame, path: str, rows_per_file: int = 250_000) -> None:
    """XML shards with ``<item>`` lists."""
    shaped = df.select(*[F.struct(F.col(c).alias("item")).alias(c) if c in LISTS else F.col(c) for c in df.columns])
    shaped.write.format("xml").option("maxRecordsPerFile", rows_per_file).option("rowTag", "row").option("rootTag", "rows").save(path)


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one of two tables, with the side, counting repeats."""
    cols = a.columns
    return a.exceptAll(b.select(cols)).withColumn("side", F.lit("a")).unionByName(b.select(cols).exceptAll(a).withColumn("side", F.lit("b")))
