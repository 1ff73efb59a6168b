"""Readers of capture files: CSV, JSON Lines and XML, plain or compressed, and vendor lists.

The kind of a file is told by its content, not its name. Files are listed in name
order, which fixes the row numbers.
"""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.operators.intake import IntakeError
from peerlens.operators.rejects import COLUMNS
from peerlens.runtime import durable

# File suffixes of captures, magic bytes of containers, list columns.
SUFFIXES, PACKED = ("csv", "jsonl", "json", "xml", "txt"), ("zst", "zstd", "gz")
ZSTD, GZIP = b"\x28\xb5\x2f\xfd", b"\x1f\x8b"
LISTS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts", "script_types")


def is_capture(name: str) -> bool:
    """Whether a file name is a capture's; dot files and metadata are none."""
    parts = name.lower().split(".")
    if name.startswith(".") or name == "_meta.json" or len(parts) < 2:
        return False
    return parts[-1] in SUFFIXES or (parts[-1] in PACKED and len(parts) > 2 and parts[-2] in SUFFIXES)


def discover(spark: SparkSession, path: str) -> list[str]:
    """Capture files of a file or folder on any Hadoop file system, sorted by name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(root).isFile():
        return [path]
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(root) if s.isFile()]
    return [full for name, full in sorted(found) if is_capture(name)]


def input_hashes(spark: SparkSession, files: list[str]) -> DataFrame:
    """(name, size, sha256) of the files as they arrived, before anything is decoded."""
    raw = spark.read.format("binaryFile").load(files)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def unpack(data: bytes) -> bytes:
    """Content of a container told by its magic bytes; other data as it is."""
    if data.startswith(ZSTD):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    return gzip.decompress(data) if data.startswith(GZIP) else data


def decode(data: bytes, name: str = "") -> str:
    """UTF-8 text without byte order mark; other bytes are an error that names the offset."""
    try:
        return data.decode("utf-8").removeprefix("\uFEFF")
    except UnicodeDecodeError as e:
        raise IntakeError(f"{name}: not UTF-8 at byte {e.start}") from e


def sniff(text: str, name: str = "") -> str:
    """xml, jsonl or csv by the first character that is not blank."""
    head = text.lstrip()[:1]
    if not head:
        raise IntakeError(f"{name}: empty file")
    if head == "[":
        raise IntakeError(f"{name}: a JSON array is no capture")
    return {"<": "xml", "{": "jsonl"}.get(head, "csv")


def _scalar(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    text = str(value).strip()
    return text or None


def _items(value: object) -> list[str]:
    if value is None:
        return []
    if isinstance(value, list):
        return [str(v).strip() for v in value]
    text = str(value)
    return [t.strip() for t in text.split("|")] if text.strip() else []


def canonical(headers: list[str], aliases: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Header -> column of the first spelling of each column, and the headers left unknown."""
    names, lost, seen = {}, [], set()
    for h in headers:
        key = h.replace("\uFEFF", "").strip().lower()
        column = key if key in COLUMNS else aliases.get(key)
        if column is None or column in seen:
            lost.append(h)
        else:
            seen.add(column)
            names[h] = column
    return names, lost


def parse(text: str, kind: str, aliases: dict[str, str], name: str = "") -> Iterator[dict]:
    """Rows of one file as dicts of the canonical columns."""
    if kind == "csv":
        import csv

        rows = csv.reader(io.StringIO(text))
        head = next(rows)
        names, _ = canonical(head, aliases)
        for cells in rows:
            if not any(c.strip() for c in cells):
                continue
            raw = dict(zip(head, cells, strict=False))
            yield {c: (_items(raw.get(h)) if c in LISTS else _scalar(raw.get(h))) for h, c in names.items()}
    elif kind == "jsonl":
        for no, line in enumerate(text.split("\n"), 1):
            if not line.strip():
                continue
            try:
                raw = json.loads(line, parse_float=str)
            except ValueError as e:
                raise IntakeError(f"{name}: line {no} is no JSON") from e
            if not isinstance(raw, dict):
                raise IntakeError(f"{name}: line {no} is no object")
            names, _ = canonical(list(raw), aliases)
            yield {c: (_items(raw[h]) if c in LISTS else _scalar(raw[h])) for h, c in names.items()}
    else:
        if re.search("<!DOCTYPE", text[:4096], re.IGNORECASE):
            raise IntakeError(f"{name}: a document type declaration is not accepted")
        from xml.etree import ElementTree

        for row in ElementTree.fromstring(text):
            raw = {}
            for child in row:
                items = child.findall("item")
                raw[child.tag] = [i.text or "" for i in items] if items else (child.text or None)
            names, _ = canonical(list(raw), aliases)
            yield {c: (_items(raw[h]) if c in LISTS else _scalar(raw[h])) for h, c in names.items()}


def read_capture(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """All rows of all files as text, lists as arrays, with file, line and row numbers.

    Files are read in parallel, one task per file; ``row_id`` counts rows across
    the files in name order. Columns absent from a file are null, lists empty.
    """
    files = discover(spark, path)
    if not files:
        raise IntakeError(f"{path}: no capture files")
    known = dict(aliases or {})
    order = {f.rsplit("/", 1)[-1]: i for i, f in enumerate(files)}
    schema = "file_no int, line_no long, " + ", ".join(f"`{c}` " + ("array<string>" if c in LISTS else "string") for c in COLUMNS)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                base = name.rsplit("/", 1)[-1]
                text = decode(unpack(bytes(content)), base)
                rows, at = [], 0
                for row in parse(text, sniff(text, base), known, base):
                    rows.append([order[base], at, *[row.get(c, [] if c in LISTS else None) for c in COLUMNS]])
                    at += 1
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file_no", "line_no", *COLUMNS])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file_no", "line_no", *COLUMNS])

    raw = spark.read.format("binaryFile").load(files).select("path", "content").repartition(len(files), "path").mapInPandas(load, schema)
    # written once: the files are neither read nor parsed again for the offsets, which are one row per file
    raw = durable(raw, "capture")
    sizes = {r["file_no"]: r["n"] for r in raw.groupBy("file_no").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, offsets = 0, []
    for i in range(len(files)):
        offsets.append((i, start))
        start += sizes.get(i, 0)
    base = F.broadcast(spark.createDataFrame(offsets, "file_no int, _start long"))
    return raw.join(base, "file_no").withColumn("row_id", F.col("_start") + F.col("line_no")).drop("_start")


def read_large_csv(spark: SparkSession, path: str) -> DataFrame:
    """One schema's CSV as text columns through Spark's own splitting reader."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False, quote='"', escape='"')


def read_large_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines with all values as text; a broken line fails the read."""
    schema = ", ".join(f"`{c}` " + ("array<string>" if c in LISTS else "string") for c in COLUMNS)
    return spark.read.schema(schema).option("primitivesAsString", True).option("mode", "FAILFAST").json(path)


def read_large_xml(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    """XML rows with list items, all values as text."""
    schema = ", ".join(f"`{c}` " + ("struct<item: array<string>>" if c in LISTS else "string") for c in COLUMNS)
    rows = spark.read.schema(schema).option("rowTag", row_tag).format("xml").load(path)
    return rows.select(*[F.coalesce(F.col(f"{c}.item"), F.array().cast("array<string>")).alias(c) if c in LISTS else F.col(c) for c in COLUMNS])


def vendor_blocks(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Vendor network blocks of a folder tree, as text columns."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(path, header=True)


def address_list(spark: SparkSession, path: str) -> DataFrame:
    """(ip): addresses of a text list, one per line or after a keyword; comments are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*#"))
    token = F.explode(F.split(F.trim("value"), r"\s+")).alias("ip")
    return lines.select(token).where(F.col("ip").rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") | F.col("ip").rlike("^[0-9a-fA-F:]*:[0-9a-fA-F:]+$")).distinct()


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a parquet table from its footers."""
    return spark.read.parquet(path).count()


def peek(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values of a column with their share; ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("_all")).alias("share")).orderBy(F.desc("n"), F.col(column).asc_nulls_first()).limit(n)
