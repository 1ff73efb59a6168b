"""Rows that fail to parse, with the reason for each (problem 7).

For a schema an anchored regular expression of the whole row is generated. Rows
that match it are well formed; the others pass through a series of incremental
field prefixes that names the first broken field, and an ordered list of checks
gives the reason. All of it stays in JVM expressions: one scan of the header
lines, one of all lines. Rows of a file whose header has the columns in another
order are brought into the schema's order first, by an index that comes from the
header, so any number of orders takes the same two scans.

The patterns only use possessive loops, which Java runs without recursion, so
cells of any length are safe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.runtime import durable, hot_keys, skew_join, small

# The capture columns in file order.
COLUMNS = (
    "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "txid", "input_addresses", "input_amounts", "output_addresses",
    "output_amounts", "geo_country", "asn", "fee_sats", "vsize", "script_types", "block_height", "msg_type", "observer_id",
)
REQUIRED = COLUMNS[:6]
INTEGERS = ("src_port", "dst_port", "asn", "fee_sats", "vsize", "block_height")
# What counts as blank around a cell.
WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

_ANY = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000][^",]*+|)'
_CELL = rf"{WS}*+{_ANY}{WS}*+"
GRAMMAR = rf"\A(?:,{_CELL})++\z"

_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[Tt ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d++)?+)?+(?: ?(?:[Zz]|[+\-](?:[01]\d|2[0-3])(?::?[0-5]\d)?+))?+"
_BASIC = r"\d{4}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[Tt](?:[01]\d|2[0-3])[0-5]\d(?:[0-5]\d(?:[.,]\d++)?+)?+(?:[Zz]|[+\-](?:[01]\d|2[0-3])(?::?[0-5]\d)?+)?+"
TIME = rf"(?:{_DATE}|{_BASIC}|\d++)"
INTEGER = r"[+\-]?+\d++"
AMOUNTS = r"\d++(?:\|\d++)*+"
TXID = r"[0-9a-f]{64}"


def _field(name: str) -> str:
    """Pattern of one trimmed cell of a well-formed row."""
    core = {"timestamp": TIME, "txid": TXID, "input_amounts": AMOUNTS, "output_amounts": AMOUNTS}.get(name) or (INTEGER if name in INTEGERS else None)
    if core is None:
        quoted = r'[^"]*+(?:""[^"]*+)*+'
        bare = r'[^",]*+'
        if name in REQUIRED:  # at least one character that is not blank
            return rf'(?:{WS}*+"(?!{WS}*+"(?!")){quoted}"{WS}*+|(?!{WS}*+(?:,|\z)){bare})'
        return rf'(?:{WS}*+"{quoted}"{WS}*+|{bare})'
    opt = "" if name in REQUIRED else "?+"
    return rf'{WS}*+(?:"{WS}*+(?:{core}){opt}{WS}*+"|(?:{core})){opt}{WS}*+'


def row_pattern(columns: tuple[str, ...] = COLUMNS) -> str:
    """Anchored pattern of a whole well-formed row of the schema."""
    return r"\A" + ",".join(_field(c) for c in columns) + r"\z"


def prefix_patterns(columns: tuple[str, ...] = COLUMNS) -> list[str]:
    """Anchored patterns of the first 1, 2, ... fields."""
    return [r"\A" + ",".join(_field(c) for c in columns[: i + 1]) + r"(?=,|\z)" for i in range(len(columns))]


def cells(line: Column) -> Column:
    """Trimmed cells of a line that obeys the grammar; blank cells are empty."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({_CELL})"), F.lit(1))
    trim = lambda c: F.regexp_replace(c, rf"\A{WS}++|{WS}++\z", "")
    return F.transform(
        raw,
        lambda c: F.when(trim(c).startswith('"'), trim(F.regexp_replace(F.regexp_replace(trim(c), r'\A"|"\z', ""), '""', '"'))).otherwise(trim(c)),
    )


def _valid_day(cell: Column) -> Column:
    """Whether the day of an ISO text exists in its month (year 0 does not)."""
    d = F.regexp_replace(F.substring(cell, 1, 10), "-", "")
    part = lambda at, n: F.substring(d, at, n).try_cast("int")
    return (part(1, 4) > 0) & F.try_make_timestamp(part(1, 4), part(5, 2), part(7, 2), F.lit(0), F.lit(0), F.lit(0)).isNotNull()


def _items(cell: Column) -> Column:
    return F.when(cell == "", 0).otherwise(F.size(F.split(cell, r"\|", -1)))


def in_order(line: Column, order: Column, width: int) -> Column:
    """The line with its raw cells in the order that the index tells; as it is, where it cannot be split so."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({_CELL})"), F.lit(1))
    splits = F.concat(F.lit(","), line).rlike(GRAMMAR) & (F.size(raw) == width)
    return F.when(order.isNotNull() & splits, F.array_join(F.transform(order, lambda i: F.get(raw, i)), ",")).otherwise(line)


def classify(lines: DataFrame, columns: tuple[str, ...] = COLUMNS, line: str = "line") -> DataFrame:
    """``lines`` with reject_reason (null: loads), first_broken and the cells.

    ``first_broken`` is the first field of the schema whose prefix pattern fails;
    it is null for rows that match the row pattern and for failures between fields.
    """
    text = F.col(line)
    # each generator is a barrier: filters on the reason cannot pull a copy of the pattern work below it
    prefix = F.lit(len(columns))
    for i, pattern in reversed(list(enumerate(prefix_patterns(columns)))):
        prefix = F.when(~text.rlike(pattern), i).otherwise(prefix)
    step = lines.withColumn("_whole", F.explode(F.array(text.rlike(row_pattern(columns)))))
    shape = F.struct(
        F.when(~F.col("_whole"), prefix).alias("first"),
        F.when(F.col("_whole") | F.concat(F.lit(","), text).rlike(GRAMMAR), cells(text)).alias("cells"),
    )
    step = step.withColumn("_s", F.explode(F.array(shape)))
    first = F.col("_s.first")
    cell = {c: F.get(F.col("_s.cells"), F.lit(i)) for i, c in enumerate(columns)}
    at = {c: i for i, c in enumerate(columns)}
    # a field before the first broken one is known to be well formed
    some = lambda names, bad: reduce(lambda a, b: a | b, [(first <= at[c]) & bad(cell[c]) for c in names])
    blank = some(REQUIRED, lambda x: x == "")
    bad_txid = some(["txid"], lambda x: ~x.rlike(rf"\A{TXID}\z"))
    bad_int = some(INTEGERS, lambda x: (x != "") & ~x.rlike(rf"\A{INTEGER}\z"))
    bad_amount = some(["input_amounts", "output_amounts"], lambda x: (x != "") & ~x.rlike(rf"\A{AMOUNTS}\z"))
    stamp = cell["timestamp"]
    bad_time = ~stamp.rlike(r"\A\d++\z") & ~(stamp.rlike(rf"\A{TIME}\z") & _valid_day(stamp))
    reason = (
        F.when(F.col("_s.cells").isNull(), "broken_quoting")
        .when(F.size("_s.cells") != len(columns), "wrong_column_count")
        .when(blank, "missing_required_value")
        .when(bad_txid, "txid_malformed")
        .when(bad_time, "timestamp_unparseable")
        .when(bad_int, "integer_unparseable")
        .when(bad_amount, "amount_unparseable")
        .when(_items(cell["input_addresses"]) != _items(cell["input_amounts"]), "input_length_mismatch")
        .when(_items(cell["output_addresses"]) != _items(cell["output_amounts"]), "output_length_mismatch")
        .when(cell["output_addresses"] == "", "no_outputs")
    )
    broken = F.get(F.array(*[F.lit(c) for c in columns]), first)
    return step.withColumn("reject_reason", reason).withColumn("first_broken", broken).withColumn("_cells", F.col("_s.cells")).drop("_whole", "_s")


def data_lines(lines: DataFrame) -> DataFrame:
    """The rows among the lines: neither header lines nor null or blank ones."""
    return lines.where(~F.coalesce(F.col("line_no") == 0, F.lit(False)) & F.col("line").isNotNull() & ~F.col("line").rlike(rf"\A{WS}*+\z"))


def header_key(line: Column) -> Column:
    """Header line as compared: lower case, without byte order mark, quotes and blanks."""
    return F.lower(F.regexp_replace(line, rf'{WS}|["\uFEFF]', ""))


def header_orders(lines: DataFrame, known: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(source_file, _order) of the files whose header names exactly the known columns in another order.

    ``_order`` holds the position in the file of each known column. All other
    files are read in the standard order. Of several header lines of a file the
    first by code point counts.
    """
    standard = F.array(*[F.lit(c) for c in known])
    head = lines.where((F.col("line_no") == 0) & F.col("line").isNotNull() & F.col("source_file").isNotNull())
    head = head.select("source_file", header_key(F.col("line")).alias("_h")).groupBy("source_file").agg(F.split(F.min("_h"), ",").alias("_h"))
    head = head.where((F.col("_h") != standard) & (F.array_sort("_h") == F.array_sort(standard)))
    return head.select("source_file", F.transform(standard, lambda c: (F.array_position("_h", c) - 1).cast("int")).alias("_order"))


def reject_lines(lines: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``classify`` over all data lines, each file read in its header's order.

    Null lines, blank lines and header lines are no rows; repeated lines are
    judged one by one; an empty table gives an empty result.
    """
    rows = data_lines(lines)
    orders = durable(header_orders(lines, columns), "orders")
    if orders.isEmpty():
        return classify(rows, columns)
    few = small(orders)
    rows = rows.join(few, "source_file", "left") if few is not orders else skew_join(rows, orders, "source_file", hot_keys(rows, "source_file"), "left")
    # a barrier as in classify: the line is put in order once
    rows = rows.withColumn("_line", F.explode(F.array(in_order(F.col("line"), F.col("_order"), len(columns)))))
    return classify(rows, columns, "_line").drop("_line", "_order")


def rejected(lines: DataFrame) -> DataFrame:
    """(line_id, reject_reason) of the rows that cannot be loaded."""
    return reject_lines(lines).where(F.col("reject_reason").isNotNull()).select("line_id", "reject_reason")


def loaded(lines: DataFrame) -> DataFrame:
    """The rows that load, as text columns; blank cells are null."""
    good = reject_lines(lines).where(F.col("reject_reason").isNull())
    value = lambda i: F.get(F.col("_cells"), F.lit(i))
    return good.select("line_id", "source_file", "line_no", *[F.when(value(i) != "", value(i)).alias(c) for i, c in enumerate(COLUMNS)])
