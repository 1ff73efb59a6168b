"""Schemas that drift between the files of a feed (problem 5).

Consecutive files are matched by similarity flooding: both schemas become graphs
of columns, names, types and nesting, match scores spread over the pairs of nodes
until they converge, and a consistent one-to-one set of correspondences is
selected. Correspondences are then checked exactly against the alias dictionary,
and records are cast and unioned into one table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.operators.ordered import last_before
from peerlens.runtime import durable

# Columns that one table may have.
MOST_COLUMNS = 1_000
# List-valued and integer-valued columns of the one table.
LISTS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts", "script_types")
WHOLE = ("src_port", "dst_port", "asn", "fee_sats", "vsize", "block_height")
# Flooding has converged when no score moves by more than EPSILON; no convergence in ROUNDS is an error.
EPSILON = 1e-4
ROUNDS = 10_000


def header_as_compared(header: Column) -> Column:
    """Header without byte order mark, trimmed and lower-cased."""
    return F.lower(F.regexp_replace(F.translate(header, "\uFEFF", ""), r"^[\s\x0B\x1C-\x1F\x85\xA0]+|[\s\x0B\x1C-\x1F\x85\xA0]+$", ""))


def resolved_headers(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, header, pos, spelling, column_name, known) of every column of a file.

    Of two headers with the same column the first counts; the later one is an
    unknown column under its own spelling, and a further header with an unknown
    column already seen in its file is dropped. Null headers are skipped.
    """
    spelled = files.where(F.col("file_id").isNotNull()).select("file_id", F.posexplode("headers").alias("pos", "header")).where(F.col("header").isNotNull())
    spelled = spelled.withColumn("spelling", header_as_compared(F.col("header")))
    names = aliases.select(F.col("column_name").alias("spelling"), F.col("column_name").alias("_column")).union(aliases.select("alias", "column_name"))
    # an alias that is itself a column name means that column
    names = names.where(F.col("spelling").isNotNull() & F.col("_column").isNotNull())
    names = names.groupBy("spelling").agg(F.coalesce(F.min(F.when(F.col("spelling") == F.col("_column"), F.col("_column"))), F.min("_column")).alias("_column"))
    joined = spelled.join(names, "spelling", "left")
    first = Window.partitionBy("file_id", "_column").orderBy("pos")
    known = F.col("_column").isNotNull() & (F.row_number().over(first) == 1)
    marked = joined.withColumn("known", known).withColumn("column_name", F.when(F.col("known"), F.col("_column")).otherwise(F.col("spelling")))
    once = Window.partitionBy("file_id", "known", "column_name").orderBy("pos")
    return marked.withColumn("_n", F.row_number().over(once)).where(F.col("_n") == 1).select("file_id", "header", "pos", "spelling", "column_name", "known")


def value_kinds(records: DataFrame) -> DataFrame:
    """(file_id, header, kind, inner): JSON types of each key's non-null values.

    ``kind`` is whole, fraction, string, array, boolean or object; several in one
    file are joined by ``+``. ``inner`` has what nests in its arrays and objects, as
    the type text that the values have. Records that are no JSON object count for nothing.
    """
    spark = records.sparkSession
    parsed = records.where(F.col("file_id").isNotNull()).select("file_id", F.try_parse_json("record").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    fields = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file_id", F.col("key").alias("header"), F.schema_of_variant("value").alias("t"))
    kind = (
        F.when(F.col("t") == "BIGINT", "whole")
        .when(F.col("t").rlike(r"^DECIMAL\(\d+,0\)$"), "whole")
        .when(F.col("t").startswith("DECIMAL") | F.col("t").isin("DOUBLE", "FLOAT"), "fraction")
        .when(F.col("t") == "STRING", "string")
        .when(F.col("t").startswith("ARRAY"), "array")
        .when(F.col("t") == "BOOLEAN", "boolean")
        .when(F.col("t").startswith("OBJECT"), "object")
    )
    # distinct first: partial aggregation leaves one row per file, key and kind
    seen = fields.select("file_id", "header", kind.alias("kind"), F.regexp_extract("t", r"(?s)^(?:ARRAY|OBJECT)<(.*)>$", 1).alias("inner")).where(F.col("kind").isNotNull()).distinct()
    return seen.groupBy("file_id", "header").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kind"),
        F.array_sort(F.collect_set(F.when(~F.col("inner").isin("", "VOID"), F.col("inner")))).alias("inner"),
    )


def file_schemas(files: DataFrame, records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(feed, file_no, fields) with the columns of each file in file order."""
    typed = resolved_headers(files, aliases).join(value_kinds(records), ["file_id", "header"], "left")
    fields = typed.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "spelling", "column_name", "known", "kind", "inner"))).alias("fields"))
    # of several files with one number in a feed, the smallest file_id counts
    number = files.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()).groupBy("feed", "file_no").agg(F.min("file_id").alias("file_id"))
    return number.join(fields, "file_id", "left").select("feed", "file_no", "fields")


def consecutive(schemas: DataFrame) -> DataFrame:
    """Each file with the fields of the one before it in its feed.

    Neighbours without a gap in their numbers meet by an equi-join on unique
    keys, so a feed with a third of all files is spread like any other. For files
    beside gaps only the numbers are ordered, and the fields join them afterwards.
    """
    after = schemas.select("feed", (F.col("file_no") + 1).cast("int").alias("file_no"), F.col("fields").alias("old"), F.lit(True).alias("_has"))
    here = schemas.withColumn("_is", F.lit(True))
    joined = here.join(after, ["feed", "file_no"], "full")
    direct = joined.where(F.col("_has") & F.col("_is")).select("feed", "file_no", "old", F.col("fields").alias("new"))
    ends = joined.where(F.col("_has").isNull()).select("feed", "file_no", F.lit(1).alias("_side"))
    starts = joined.where(F.col("_has") & F.col("_is").isNull()).select("feed", (F.col("file_no") - 1).cast("int").alias("file_no"), F.lit(0).alias("_side"))
    # at one number the file that looks back sorts before the same file as a predecessor
    numbers = ends.unionByName(starts).withColumn("_own", F.when(F.col("_side") == 0, F.col("file_no")))
    jumps = last_before(numbers, ["feed"], [F.col("file_no").asc(), F.col("_side").desc()], "_own", "_old", strict=True)
    jumps = jumps.where((F.col("_side") == 1) & F.col("_old").isNotNull()).select("feed", "file_no", "_old")
    new = schemas.select("feed", "file_no", F.col("fields").alias("new"))
    old = schemas.select("feed", F.col("file_no").alias("_old"), F.col("fields").alias("old"))
    return direct.unionByName(jumps.join(new, ["feed", "file_no"]).join(old, ["feed", "_old"]).select("feed", "file_no", "old", "new"))


@lru_cache(maxsize=100_000)
def _grams(name: str) -> frozenset[str]:
    padded = f"^{name}$"
    return frozenset(padded[i : i + 3] for i in range(len(padded) - 2)) or frozenset([padded])


@lru_cache(maxsize=500_000)
def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of character trigrams."""
    x, y = _grams(a), _grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def _types(field) -> set[str]:
    """Type nodes of a column: its own type and the types nested in it."""
    inner = field["inner"] if "inner" in field else None
    return {field["kind"] or "", *(f"<{t}>" for t in (inner if inner is not None else ()))}


def flood(old: list, new: list) -> np.ndarray:
    """Converged match scores of two column lists, as a matrix.

    Nodes: columns, their resolved names, their types, what nests in them, and the
    file. A pair of columns starts at 1 if the alias dictionary gives both one name,
    else at half their trigram similarity. Pairs spread their score along equal edges
    (column to name, to type, to nested type, to file), each edge weighted by the
    inverse number of pairs that share it; scores are divided by the largest after
    every round.
    """
    n, m = len(old), len(new)
    concept_old = [(f["known"], f["column_name"]) for f in old]
    concept_new = [(f["known"], f["column_name"]) for f in new]
    same = np.array([[1.0 if a == b else 0.0 for b in concept_new] for a in concept_old]).reshape(n, m)
    spelled = np.array([[name_similarity(a["spelling"], b["spelling"]) for b in new] for a in old]).reshape(n, m)
    start = np.where(same > 0, 1.0, 0.5 * spelled)
    types_old, types_new = [_types(f) for f in old], [_types(f) for f in new]
    kinds = sorted(set().union(*types_old, *types_new))
    of_old = np.array([[float(k in t) for k in kinds] for t in types_old]).reshape(n, len(kinds))
    of_new = np.array([[float(k in t) for k in kinds] for t in types_new]).reshape(m, len(kinds))
    type_start = np.eye(len(kinds))
    shared = np.maximum(1.0, np.outer(of_old.sum(0), of_new.sum(0)))
    col, name, kind, root = start.copy(), same.copy(), type_start.copy(), 1.0
    for _ in range(ROUNDS):
        c, t, x = start + col, same + name, type_start + kind
        col2 = c + t + of_old @ (x / shared) @ of_new.T + (1.0 + root) / (n * m)
        name2 = t + c  # each name node has one column on either side
        kind2 = x + of_old.T @ c @ of_new / shared
        root2 = 1.0 + root + c.sum() / (n * m)
        top = max(col2.max(), name2.max(), kind2.max(), root2)
        col2, name2, kind2, root2 = col2 / top, name2 / top, kind2 / top, root2 / top
        moved = max(np.abs(col2 - col).max(), np.abs(name2 - name).max(), np.abs(kind2 - kind).max())
        col, name, kind, root = col2, name2, kind2, root2
        if moved < EPSILON:
            return col
    raise ArithmeticError(f"similarity flooding did not converge in {ROUNDS} rounds")


def select(scores: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one correspondences: best remaining pair first, ties by position."""
    n, m = scores.shape
    order = np.lexsort((np.tile(np.arange(m), n), np.repeat(np.arange(n), m), -scores.ravel()))
    left, right, out = set(range(n)), set(range(m)), []
    for k in order:
        i, j = divmod(int(k), m)
        if i in left and j in right:
            out.append((i, j))
            left.discard(i)
            right.discard(j)
            if not left or not right:
                break
    return out


def changes(old: list, new: list) -> list[tuple[str, str]]:
    """(column_name, change_kind) between two column lists."""
    out: list[tuple[str, str]] = []
    matched_old, matched_new = set(), set()
    if old and new:
        for i, j in select(flood(old, new)):
            a, b = old[i], new[j]
            if (a["known"], a["column_name"]) != (b["known"], b["column_name"]):
                continue  # look alike, but the dictionary says otherwise
            matched_old.add(i)
            matched_new.add(j)
            if a["spelling"] != b["spelling"]:
                out.append((b["column_name"], "renamed"))
            if a["kind"] and b["kind"] and a["kind"] != b["kind"]:
                out.append((b["column_name"], "retyped"))
    out += [(f["column_name"], "removed") for i, f in enumerate(old) if i not in matched_old]
    out += [(f["column_name"], "added") for j, f in enumerate(new) if j not in matched_new]
    return out


def schema_changes(files: DataFrame, records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(feed, file_no, column_name, change_kind) of every change in every feed.

    The first file of a feed changes nothing. Files with a null feed or number
    are left out; a file without records has columns without types, and a type
    that is unknown on either side is no change. Empty tables give no rows.
    """
    # one row per file: written once, as the pairing reads it on several sides
    pairs = consecutive(durable(file_schemas(files, records, aliases), "schemas"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for feed, no, old, new in zip(frame["feed"], frame["file_no"], frame["old"], frame["new"], strict=True):
                rows += [(feed, int(no), c, k) for c, k in changes(list(old) if old is not None else [], list(new) if new is not None else [])]
            yield pd.DataFrame(rows, columns=["feed", "file_no", "column_name", "change_kind"]).astype({"file_no": "int64"})

    return pairs.mapInPandas(compare, "feed string, file_no long, column_name string, change_kind string").distinct()


def unified_records(files: DataFrame, records: DataFrame, aliases: DataFrame) -> DataFrame:
    """All records of all files in one schema.

    One row per record: feed, file_no, row_no, the columns of the alias table
    (lists as array<string>, whole numbers as bigint, others as string; a value
    that cannot be cast is null) and ``other``, a map of the unknown columns and of
    keys that the headers lack; of several values under one such name the first
    stays. Records of unknown files and texts that are no JSON object are left out;
    a repeated file_id counts once. More than MOST_COLUMNS names raise, as none may
    get lost.
    """
    names = aliases.where(F.col("column_name").isNotNull()).select("column_name").distinct().limit(MOST_COLUMNS + 1).collect()
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"the alias table names more than {MOST_COLUMNS} columns")
    columns = sorted(r[0] for r in names)
    # of equal headers of a file the first gives the name
    first = resolved_headers(files, aliases).groupBy("file_id", "header").agg(F.min_by(F.struct("known", "column_name"), "pos").alias("_name"))
    heads = first.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("header", "_name"))).alias("_names"))
    keyed = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.min_by("feed", F.coalesce("file_no", F.lit(0))).alias("feed"), F.min("file_no").alias("file_no")).join(heads, "file_id", "left")
    rows = records.select("file_id", "row_no", F.map_entries(F.from_json("record", "map<string,string>")).alias("_e")).where(F.col("_e").isNotNull()).join(keyed, "file_id")
    # a key that comes again in one record, and a key that the file's headers lack, are unknown columns
    named = F.transform("_e", lambda e, i: F.struct(
        e["key"].alias("key"), e["value"].alias("value"),
        F.when(F.array_position(F.transform("_e", lambda x: x["key"]), e["key"]) == i + 1, F.try_element_at("_names", e["key"])).alias("name"),
    ))
    rows = rows.withColumn("_e", named)
    known = lambda e: F.coalesce(e["name"]["known"], F.lit(False))
    rows = rows.withColumn("_known", F.map_from_entries(F.transform(F.filter("_e", known), lambda e: F.struct(e["name"]["column_name"], e["value"]))))
    rest = F.transform(F.filter("_e", lambda e: ~known(e)), lambda e: F.struct(F.coalesce(e["name"]["column_name"], e["key"]).alias("key"), e["value"].alias("value")))
    rows = rows.withColumn("_o", rest)
    rows = rows.withColumn("other", F.map_from_entries(F.filter("_o", lambda e, i: F.array_position(F.transform("_o", lambda x: x["key"]), e["key"]) == i + 1)))

    def cast(c: str) -> Column:
        text = F.try_element_at("_known", F.lit(c))
        if c in LISTS:
            return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\|"))
        return F.trim(text).try_cast("bigint") if c in WHOLE else text

    return rows.select("feed", "file_no", "row_no", *[cast(c).alias(c) for c in columns], "other")
