"""Intake of one capture: unit and clock detection, ordered rejects, agreement checks, accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.operators.rejects import INTEGERS, REQUIRED

# Chain columns on which all rows of a transaction must agree.
CHAIN = ("input_addresses", "output_addresses", "input_amounts", "output_amounts", "fee_sats", "vsize", "script_types", "block_height")
INT_SHAPE, DEC_SHAPE = r"^[0-9]+$", r"^[0-9]+\.[0-9]+$"
TXID = "^[0-9a-f]{64}$"
# More than one reject in a hundred rows stops an intake.
BREAKER = 100


class IntakeError(ValueError):
    """A capture that as a whole cannot be read one way."""


def amount_shapes(rows: DataFrame, columns: tuple[str, ...] = ("input_amounts", "output_amounts")) -> DataFrame:
    """(column, n_int, n_dec, n_junk): shapes of the amount tokens of each column."""
    parts = []
    for c in columns:
        t = rows.select(F.explode(c).alias("t"))
        parts.append(t.agg(F.count_if(F.col("t").rlike(INT_SHAPE)).alias("n_int"), F.count_if(F.col("t").rlike(DEC_SHAPE)).alias("n_dec"), F.count_if(~F.col("t").rlike(INT_SHAPE) & ~F.col("t").rlike(DEC_SHAPE)).alias("n_junk")).select(F.lit(c).alias("column"), "n_int", "n_dec", "n_junk"))
    return reduce(DataFrame.unionByName, parts)


def detect_unit(rows: DataFrame) -> str:
    """sats or btc for a whole capture.

    All readable tokens whole: sats; all with a point: btc; both kinds in one
    column, or columns that differ, are an error; nothing readable: sats.
    """
    kinds = set()
    for r in amount_shapes(rows).collect():  # one row per amount column
        if r["n_int"] and r["n_dec"]:
            raise IntakeError(f"{r['column']}: whole and fractional amounts in one file")
        if r["n_int"] or r["n_dec"]:
            kinds.add("sats" if r["n_int"] else "btc")
    if len(kinds) > 1:
        raise IntakeError("amount columns in different units")
    return kinds.pop() if kinds else "sats"


def sats(token: Column, unit: str) -> Column:
    """Whole satoshis of a token in the file's unit; null if it has another shape or is finer."""
    if unit == "sats":
        return F.when(token.rlike(INT_SHAPE), token.try_cast("bigint"))
    value = F.when(token.rlike(DEC_SHAPE), token.try_cast("decimal(28,10)")) * F.lit(100_000_000).cast("decimal(9,0)")
    return F.when(value == F.floor(value), value.try_cast("bigint"))


def clocks(rows: DataFrame, by: list[str], column: str = "timestamp") -> DataFrame:
    """(by..., clock): iso, s, ms or us of each capture, by its widest value; any text that is no number: iso.

    Blank and null texts tell nothing; a capture with no others is absent.
    """
    text = F.trim(column)
    r = rows.where(text != "").groupBy(*by).agg(F.bool_and(text.rlike(r"^-?[0-9]+$")).alias("_numeric"), F.max(F.length(F.regexp_replace(text, "^-", ""))).alias("_width"))
    return r.select(*by, F.when(~F.col("_numeric"), "iso").when(F.col("_width") >= 15, "us").when(F.col("_width") >= 12, "ms").otherwise("s").alias("clock"))


def detect_clock(rows: DataFrame, column: str = "timestamp") -> str:
    """The clock of one whole capture; an empty one counts as iso."""
    r = clocks(rows.select(F.lit(0).alias("_all"), column), ["_all"], column).first()
    return r["clock"] if r else "iso"


def instant(text: Column, clock: str) -> Column:
    """UTC microseconds; numbers in an ISO file are seconds, a naive ISO text is UTC."""
    scale = {"us": 1, "ms": 1_000, "s": 1_000_000, "iso": 1_000_000}[clock]
    t = F.trim(text)
    number = F.when(t.rlike(r"^-?[0-9]{1,18}$"), F.try_multiply(t.try_cast("bigint"), F.lit(scale)))
    iso = F.when(~t.rlike(r"^-?[0-9]+$"), F.unix_micros(F.try_to_timestamp(t)))
    return F.coalesce(number, iso) if clock == "iso" else number


def is_naive(text: Column) -> Column:
    """Whether an ISO text has no zone."""
    return text.rlike(r"[T ][0-9:.,]+$")


def ip_version(ip: Column) -> Column:
    """4, 6, or null for text that is no address."""
    from peerlens.operators.asof import ip_key

    return F.when(ip_key(ip).startswith("4"), 4).when(ip_key(ip).startswith("6"), 6).cast("tinyint")


def coerce(rows: DataFrame, unit: str, clock: str, fee_absent: bool = False) -> DataFrame:
    """Typed rows with ``reject_reason``, the first failure in contract order.

    Input: the capture columns as text, list columns as array<string>.
    """
    typed = rows.withColumn("ts_us", instant(F.col("timestamp"), clock))
    for c in INTEGERS:
        typed = typed.withColumn(f"_{c}", F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("bigint")))
    for c in ("input_amounts", "output_amounts"):
        typed = typed.withColumn(f"_{c}", F.transform(c, lambda t: sats(t, unit)))
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED])
    bad_int = reduce(lambda a, b: a | b, [(F.trim(c) != "") & F.col(f"_{c}").isNull() for c in INTEGERS])
    bad_amount = F.exists("_input_amounts", lambda x: x.isNull()) | F.exists("_output_amounts", lambda x: x.isNull())
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    reason = (
        F.when(missing, "missing_required_value")
        .when(~F.col("txid").rlike(TXID), "txid_malformed")
        .when(F.col("ts_us").isNull(), "timestamp_unparseable")
        .when(F.coalesce(bad_int, F.lit(False)), "integer_unparseable")
        .when(F.coalesce(bad_amount, F.lit(False)), "amount_unparseable")
        .when(n("input_addresses") != n("input_amounts"), "input_length_mismatch")
        .when(n("output_addresses") != n("output_amounts"), "output_length_mismatch")
        .when(n("output_addresses") == 0, "no_outputs")
        .when((n("input_addresses") > 0) & (total("_input_amounts") < total("_output_amounts")), "value_not_conserved")
    )
    out = typed.withColumn("reject_reason", reason)
    fee = F.col("_fee_sats")
    if fee_absent:
        fee = F.when(n("input_addresses") > 0, total("_input_amounts") - total("_output_amounts"))
    return out.withColumn("_fee_sats", fee).withColumn("naive", F.coalesce(is_naive(F.col("timestamp")), F.lit(False)))


def disagreeing(rows: DataFrame, columns: tuple[str, ...] = CHAIN) -> DataFrame:
    """(txid): transactions whose rows differ in a chain column; nulls are values."""
    return rows.groupBy("txid").agg(F.min(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("lo"), F.max(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("hi")).where("lo <> hi").select("txid")


def duplicates(rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(n_duplicates): rows equal to an earlier one in all columns but the id; they are kept."""
    cols = [c for c in rows.columns if c != id_col]
    digest = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    counts = rows.select(digest.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def accounting(rows: DataFrame) -> DataFrame:
    """(reject_reason, n) with a null reason for the rows that load: in = out + rejected."""
    return rows.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def breaker(rows: DataFrame) -> None:
    """Raise if more than one row in a hundred is rejected, naming the reasons."""
    counts = {r["reject_reason"]: r["n"] for r in accounting(rows).collect()}  # one row per reason
    read = sum(counts.values())
    rejected = read - counts.get(None, 0)
    if rejected * BREAKER > read:
        raise IntakeError(f"{rejected} of {read} rows rejected: " + ", ".join(f"{k} {v}" for k, v in sorted((k, v) for k, v in counts.items() if k)))


def column_status(headers: list[str], required: tuple[str, ...], optional: tuple[str, ...]) -> dict[str, str]:
    """MAPPED, SYNTHESISED or MISSING for every column; a missing required one is an error."""
    seen = set(headers)
    if lost := [c for c in required if c not in seen]:
        raise IntakeError(f"missing columns: {', '.join(lost)}")
    return {c: "MAPPED" if c in seen else "SYNTHESISED" if c == "fee_sats" else "MISSING" for c in (*required, *optional)}
