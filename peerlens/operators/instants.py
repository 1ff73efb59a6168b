"""Mixed timestamp texts to UTC microseconds (problem 6).

Raw texts are reduced to a dictionary of distinct (text, zone, date order), each
entry is parsed exactly once, entries are kept in a growing dictionary table, and
the parsed instants are joined back to the rows. Parsing is JVM-side: every
accepted family is rewritten to one delimited form, whose parts feed
``try_make_timestamp`` (whose zone rules read a repeated local time as the
earlier instant and a skipped one with the offset in force before the change).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.runtime import durable, shared_dir, skew_join

# Characters trimmed from both ends of a raw text.
BLANKS = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF\u200B"
# Minutes east of UTC of the zone abbreviations in common use.
ABBREVIATIONS = {
    "UTC": 0, "UT": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "PKT": 300, "IST": 330, "NPT": 345, "ICT": 420, "WIB": 420,
    "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600,
    "AEDT": 660, "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150,
    "AST": -240, "ADT": -180, "BRT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
# Month names by number.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_FRAC = r"(?:[.,](\d+))?"
_ZONE = r"[ \xA0\u202F]*(Z|z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+\-\u2212]\d{2}(?::?\d{2})?)?(?:\[([A-Za-z0-9_+\-/]+)\])?"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
NUMBER = r"^(-?)(\d+)(?:[.,](\d+))?$"
ISO = rf"^(\d{{4}})([-/]?)(\d{{2}})\2(\d{{2}})(?:[Tt]|[ ]+)(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})){_FRAC}{_ZONE}$"
ISO_MINUTE = rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt]|[ ]+)(\d{{2}}):(\d{{2}}){_ZONE}$"
NUMERIC = rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}),?[ ]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}){_FRAC})?(?:[ ]*([AaPp])\.?[Mm]\.?)?{_ZONE}$"
NAMED = rf"(?i)^(?:[a-z]{{3,9}},?[ ]+)?(\d{{1,2}})[ \-]({_MONTH})[a-z]*\.?[ \-](\d{{4}}),?[ ]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}){_FRAC})?(?:[ ]*([AaPp])\.?[Mm]\.?)?{_ZONE}$"
NAMED_US = rf"(?i)^(?:[a-z]{{3,9}},?[ ]+)?({_MONTH})[a-z]*\.?[ ]+(\d{{1,2}}),?[ ]+(\d{{4}}),?[ ]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}){_FRAC})?(?:[ ]*([AaPp])\.?[Mm]\.?)?{_ZONE}$"
_SEP = "\u0001"


def parse_instants(frame: DataFrame, raw: str = "raw", zone: str = "zone", order: str = "date_order", out: str = "ts_us") -> DataFrame:
    """``frame`` with ``out``: microseconds since 1970-01-01 UTC of each raw text, or null.

    ``zone`` is the observer's IANA zone (null: UTC) and ``order`` DMY or MDY for
    dates in which day and month are both numbers (null: DMY). A zone, offset or
    zone name inside the text counts before ``zone``. Plain numbers count seconds,
    milliseconds, microseconds or nanoseconds by their width (up to 11, 14, 17,
    more digits). Digits beyond microseconds are cut, never rounded. The steps
    are separate projections, so that no regular expression runs twice.
    """
    c = F.col
    step = frame.withColumn("_text", F.regexp_replace(raw, rf"^[{BLANKS}]+|[{BLANKS}]+$", ""))
    family = (
        F.when(c("_text").rlike(NUMBER), 0)
        .when(c("_text").rlike(ISO), 1)
        .when(c("_text").rlike(NUMERIC), F.when(F.upper(order) == "MDY", 2).otherwise(3))
        .when(c("_text").rlike(NAMED), 4)
        .when(c("_text").rlike(NAMED_US), 5)
        .when(c("_text").rlike(ISO_MINUTE), 6)
    )
    step = step.withColumn("_family", family)
    # year, month, day, hour, minute, second, fraction, am/pm, zone, zone name
    forms = {
        0: (NUMBER, ("$1", "$2", "$3")),
        1: (ISO, ("$1", "$3", "$4", "$5", "$6", "$7", "$8", "", "$9", "$10")),
        2: (NUMERIC, ("$3", "$1", "$2", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
        3: (NUMERIC, ("$3", "$2", "$1", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
        4: (NAMED, ("$3", "$2", "$1", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
        5: (NAMED_US, ("$3", "$1", "$2", "$4", "$5", "$6", "$7", "$8", "$9", "$10")),
        6: (ISO_MINUTE, ("$1", "$2", "$3", "$4", "$5", "", "", "", "$6", "$7")),
    }
    parts = F.lit(None).cast("string")
    for number_, (pattern, groups) in forms.items():
        parts = F.when(c("_family") == number_, F.regexp_replace("_text", pattern, _SEP.join(groups))).otherwise(parts)
    step = step.withColumn("_p", F.split(parts, _SEP))
    at = lambda i: F.get(c("_p"), F.lit(i))
    integer = lambda i: at(i).try_cast("int")
    ampm = F.lower(at(7))
    hour12 = F.when(integer(3).between(1, 12), integer(3) % 12 + F.when(ampm == "p", 12).otherwise(0))
    token = F.upper(at(8))
    civil = F.when(c("_family") > 0, F.struct(
        integer(0).alias("y"),
        F.when(c("_family").isin(4, 5), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(at(1), 1, 3))).cast("int")).otherwise(integer(1)).alias("mo"),
        integer(2).alias("d"),
        F.when(ampm == "", integer(3)).otherwise(hour12).alias("h"),
        integer(4).alias("mi"),
        F.when(at(5) == "", 0).otherwise(integer(5)).alias("s"),
        F.rpad(F.substring(at(6), 1, 6), 6, "0").cast("int").alias("us"),
        token.alias("token"),
        F.regexp_replace(token, "^(UTC|GMT)(?=.)|:", "").alias("off"),
        at(9).alias("name"),
    ))
    abbreviations = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    width = F.length(F.regexp_replace(at(1), "^0+(?=.)", ""))
    power = F.when(width <= 11, 6).when(width <= 14, 3).otherwise(0)
    scaled = F.when(width <= 17, F.concat(at(1), F.when(power == 0, "").otherwise(F.rpad(F.substring(at(2), F.lit(1), power), power, F.lit("0"))))).otherwise(F.substring(at(1), F.lit(1), F.length(at(1)) - 3))
    plain = F.when((c("_family") == 0) & (width <= 21), F.when(at(0) == "-", -1).otherwise(1) * scaled.try_cast("long"))
    step = step.withColumn("_c", civil).withColumn("_plain", plain)
    off = c("_c.off")
    signed = off.rlike(r"^[+\-\u2212]")
    minutes = F.substring(off, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(off, 4, 2).try_cast("int"), F.lit(0))
    offset = (
        F.when(c("_c.token") == "", None)
        .when(signed & (minutes <= 18 * 60) & (F.coalesce(F.substring(off, 4, 2).try_cast("int"), F.lit(0)) <= 59), F.when(off.startswith("+"), 1).otherwise(-1) * minutes)
        .when(~signed, F.try_element_at(abbreviations, c("_c.token")))
    )
    step = step.withColumn("_off", offset)
    where = F.when(c("_off").isNotNull(), "UTC").when(c("_c.name") != "", c("_c.name")).otherwise(F.coalesce(zone, F.lit("UTC")))
    known = (c("_c.s") <= 59) & ((c("_c.token") == "") | c("_off").isNotNull())
    whole = F.try_make_timestamp(c("_c.y"), c("_c.mo"), c("_c.d"), c("_c.h"), c("_c.mi"), c("_c.s").cast("decimal(8,6)"), where)
    step = step.withColumn("_whole", F.when(known, whole))
    value = F.unix_micros("_whole") + c("_c.us") - F.coalesce("_off", F.lit(0)).cast("long") * 60_000_000
    return step.withColumn(out, F.coalesce("_plain", value)).drop("_text", "_family", "_p", "_c", "_plain", "_off", "_whole")


KEY = ["raw", "zone", "date_order"]


def keyed_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with no null in the key: an empty zone or order is unknown."""
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in KEY[1:]})


def parse_new(texts: DataFrame, known: DataFrame | None) -> DataFrame:
    """(raw, zone, date_order, ts_us) of those distinct keyed ``texts`` that ``known`` lacks; ts_us null: no time."""
    fresh = texts.select(*KEY) if known is None else texts.select(*KEY).join(known.select(*KEY), KEY, "left_anti")
    return parse_instants(fresh.select(*KEY, *[F.when(F.col(c) != "", F.col(c)).alias(f"_{c}") for c in KEY[1:]]), zone="_zone", order="_date_order").select(*KEY, "ts_us")


def instant_dictionary(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The new entries of ``rows``: distinct (raw, zone, date_order), each parsed once.

    ``known`` is the dictionary of earlier runs; its entries are neither parsed nor returned again.
    """
    return parse_new(keyed_texts(rows.where(F.col("raw").isNotNull()).select(*KEY)).distinct(), known)


def dictionary_runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of the finished runs of a persisted dictionary, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop.Path(path)):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop.Path(path)) if s.isDirectory())
    return [f"{path}/{n}" for n in names if n.startswith("run=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]


def normalise_instants(
    sealed: DataFrame,
    observers: DataFrame,
    dictionary_path: str | None = None,
    id_col: str = "row_id",
    raw_col: str = "ts_raw",
    hot_rows: int = 100_000,
) -> DataFrame:
    """(row_id, ts_us) of every row whose raw text is a time.

    The dictionary persists at ``dictionary_path`` (null: a fresh one in the shared
    folder) and grows by the new texts of each call; one call at a time may write to
    it. Null texts, other texts and impossible dates are left out. Repeated rows keep
    one output row each; an unknown or null observer means UTC and DMY; a repeated
    observer_id takes its smallest zone and order. An empty table gives an empty
    result, and other columns of the inputs are ignored.
    """
    spark = sealed.sparkSession
    # one row per observer: the table is small, but its size is left to the planner
    zones = observers.where(F.col("observer_id").isNotNull()).groupBy("observer_id").agg(F.min("tz").alias("zone"), F.min("date_order").alias("date_order"))
    rows = sealed.select(F.col(id_col), F.col(raw_col).alias("raw"), "observer_id").where(F.col("raw").isNotNull()).join(zones, "observer_id", "left")
    keyed = keyed_texts(rows.select(id_col, *KEY))
    # the texts of this call and how often each occurs now, whatever earlier calls saw
    texts = durable(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows")), "texts")
    path = dictionary_path or f"{shared_dir(spark)}/instants-{uuid.uuid4().hex}"
    # every run adds a folder; runs are read by their folders, as two readings of one growing folder would pass for the same
    schema, runs = "raw string, zone string, date_order string, ts_us long", dictionary_runs(spark, path)
    known = spark.read.schema(schema).parquet(*runs) if runs else None
    runs.append(f"{path}/run={len(runs):06d}-{uuid.uuid4().hex}")
    parse_new(texts, known).write.parquet(runs[-1])
    found = spark.read.schema(schema).parquet(*runs).where(F.col("ts_us").isNotNull())
    # texts with very many rows are split: their entries are met in several tasks
    total, top = texts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.coalesce(F.max("n_rows"), F.lit(0))).first()
    bound = max(hot_rows, total // 20_000)
    hot = None
    if top > bound:
        marks = [(r[0], -(-r[1] // bound)) for r in texts.where(F.col("n_rows") > bound).select(F.xxhash64(*KEY), "n_rows").collect()]
        hot = spark.createDataFrame(marks, "_mark long, _salts int").groupBy("_mark").agg(F.max("_salts").alias("_salts"))
    return skew_join(keyed, found, KEY, hot).select(id_col, "ts_us")
