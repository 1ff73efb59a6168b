"""Quantities written in different units to whole satoshis (problem 2).

Distinct unit spellings (of amount tokens, of the observers' unit column and of
the words in their notes) are matched to a lexicon through an inverted index of
character n-grams; candidates are verified by a weighted edit distance. The
resulting alias dictionary is then joined to all tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from peerlens.runtime import durable, small

# Unit names and their size in satoshis.
LEXICON = {
    "sat": 1, "sats": 1, "satoshi": 1, "satoshis": 1,
    "ksat": 1_000, "ksats": 1_000, "kilosat": 1_000, "kilosatoshi": 1_000, "thousand satoshi": 1_000,
    "bit": 100, "bits": 100, "ubtc": 100, "uxbt": 100, "microbtc": 100, "microbitcoin": 100, "micro-bitcoin": 100,
    "finney": 10, "mbtc": 100_000, "mxbt": 100_000, "millibtc": 100_000, "millibitcoin": 100_000, "milli-bitcoin": 100_000,
    "cbtc": 1_000_000, "centibitcoin": 1_000_000,
    "btc": 100_000_000, "xbt": 100_000_000, "bitcoin": 100_000_000, "bitcoins": 100_000_000, "₿": 100_000_000,
    "megasat": 1_000_000,
}
# msat means a thousandth of a satoshi to some writers and a million to others; it is read as neither.
AMBIGUOUS = ("msat", "msats")
# Words that scale the unit they stand before, as numerator and denominator.
SCALES = {
    "tenths": (1, 10), "hundredths": (1, 100), "thousandths": (1, 1_000), "millionths": (1, 1_000_000),
    "billionths": (1, 1_000_000_000), "hundred-millionths": (1, 100_000_000),
    "thousands": (1_000, 1), "millions": (1_000_000, 1), "milli": (1, 1_000), "micro": (1, 1_000_000), "kilo": (1_000, 1),
}
# The accepted weighted distance, and the share of a spelling's bigrams that makes a candidate.
MAX_DISTANCE = 0.6
MIN_SHARE = 0.3

BLANK = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\u200B\u2060\uFEFF"
GROUP = r"[ \xA0\u2000-\u200A\u202F'\u2019]"
_SPLIT = rf"^([^0-9+\-.,\u2212]*?)[{BLANK}]*([+\-\u2212]?[0-9.,](?:[0-9.,]|[' \xA0\u2000-\u200A\u202F\u2019](?=[0-9]))*+(?:[eE][+\-]?[0-9]+)?)[{BLANK}]*([^0-9]*)$"


def fold_unit(text: Column) -> Column:
    """Trimmed, lower-case unit text with the micro signs written u."""
    trimmed = F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}.:;()]+$", "")
    return F.translate(F.lower(trimmed), "µμ", "uu")


def weighted_distance(a: str, b: str) -> float:
    """Edit distance whose costs say how likely two unit names are the same.

    A leading letter carries the scale (m, k, u), so any change there costs 2.
    A final s, a hyphen, dot or blank costs 0.1; a doubled letter or a swap of
    neighbours 0.4; a vowel for a vowel 0.4; anything else 1. The sum is divided
    by a quarter of the longer length, at least 1, so long names bear more.
    """
    if a == b:
        return 0.0
    soft, vowels = "-. _", "aeiouy"

    def gap(s: str, i: int) -> float:
        if s[i] in soft:
            return 0.1
        if i == 0:
            return 2.0
        if i == len(s) - 1 and s[i] == "s":
            return 0.1
        return 0.4 if s[i] == s[i - 1] else 1.0

    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        d[i][0] = d[i - 1][0] + gap(a, i - 1)
    for j in range(1, m + 1):
        d[0][j] = d[0][j - 1] + gap(b, j - 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            swap = 0.0 if x == y else 2.0 if i == 1 or j == 1 else 0.4 if x in vowels and y in vowels else 1.0
            best = min(d[i - 1][j - 1] + swap, d[i - 1][j] + gap(a, i - 1), d[i][j - 1] + gap(b, j - 1))
            if i > 2 and j > 2 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, d[i - 2][j - 2] + 0.4)
            d[i][j] = best
    return d[n][m] / max(1.0, max(n, m) / 4)


def _grams(text: Column) -> Column:
    # linear in the text, however long it is
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    return F.array_distinct(F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda x, y: F.concat(x, y)))


@F.pandas_udf(DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def nearest_names(spellings: DataFrame, names: dict[str, str]) -> DataFrame:
    """(spelling, meaning) of the distinct spellings near enough to one of ``names``.

    Candidates come from the inverted index of character bigrams; the weighted
    edit distance verifies them. If the nearest names tie and differ in meaning,
    the spelling means nothing. Null and empty spellings mean nothing.
    """
    spark = spellings.sparkSession
    lexicon = F.broadcast(spark.createDataFrame(list(names.items()), "name string, meaning string"))
    index = F.broadcast(lexicon.select("name", F.explode(_grams(F.col("name"))).alias("gram")))
    left = spellings.where((F.col("spelling") != "") & ~F.col("spelling").isin(*AMBIGUOUS)).select("spelling").distinct().select("spelling", _grams(F.col("spelling")).alias("grams"))
    shared = (
        left.select("spelling", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
        .join(index, "gram")
        .groupBy("spelling", "name")
        .agg(F.count("gram").alias("common"), F.max("n").alias("n"))
        .where(F.col("common") >= F.greatest(F.lit(1), MIN_SHARE * F.col("n")))
    )
    scored = shared.join(lexicon, "name").withColumn("d", _distance("spelling", "name")).where(F.col("d") <= MAX_DISTANCE)
    # at most the whole lexicon per spelling
    found = scored.groupBy("spelling").agg(F.array_sort(F.collect_list(F.struct("d", "meaning"))).alias("m"))
    nearest = F.filter("m", lambda x: x["d"] == F.col("m")[0]["d"])
    return found.select("spelling", F.array_distinct(F.transform(nearest, lambda x: x["meaning"])).alias("m")).where(F.size("m") == 1).select("spelling", F.col("m")[0].alias("meaning"))


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """(spelling, sats, num, den) of the distinct folded spellings, of any length, that mean something.

    ``sats`` is the size of a unit; ``num`` and ``den`` are what a scale word makes of
    the unit after it. The ambiguous unit names mean nothing.
    """
    names = {k: f"{v}" for k, v in LEXICON.items()} | {k: f"{n}/{d}" for k, (n, d) in SCALES.items()}
    part = lambda i: F.get(F.split("meaning", "/"), F.lit(i)).try_cast("long")
    found = nearest_names(spellings, names).withColumn("_scale", F.col("meaning").contains("/"))
    return found.select("spelling", F.when(~F.col("_scale"), part(0)).alias("sats"), F.when(F.col("_scale"), part(0)).alias("num"), F.when(F.col("_scale"), part(1)).alias("den"))


def note_words(observers: DataFrame) -> DataFrame:
    """(observer_id, pos, spelling) of each word of the observers' notes."""
    words = F.split(F.lower("note"), rf"[^a-zµμ₿\-]+")
    return observers.where(F.col("note").isNotNull()).select("observer_id", F.posexplode(words).alias("pos", "word")).where(F.col("word") != "").select("observer_id", "pos", fold_unit(F.col("word")).alias("spelling"))


def note_units(words: DataFrame, aliases: DataFrame) -> DataFrame:
    """(observer_id, note_sats): the unit that an observer's note tells.

    A note tells a unit if exactly one size results from its words, where a
    scale word ("thousandths of a bitcoin") changes the next unit after it.
    """
    known = words.join(aliases, "spelling").groupBy("observer_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sats", "num", "den"))).alias("w"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for observer, seq in zip(frame["observer_id"], frame["w"], strict=True):
                sizes, scale = set(), (1, 1)
                for item in seq:
                    if item["sats"] is not None and item["sats"] == item["sats"]:
                        size, rest = divmod(int(item["sats"]) * scale[0], scale[1])
                        if not rest and size:
                            sizes.add(size)
                        scale = (1, 1)
                    elif item["num"] is not None and item["num"] == item["num"]:
                        scale = (int(item["num"]), int(item["den"]))
                if len(sizes) == 1:
                    out.append((observer, sizes.pop()))
            yield pd.DataFrame(out, columns=["observer_id", "note_sats"]).astype({"note_sats": "int64"})

    return known.mapInPandas(read, "observer_id string, note_sats long")


def split_tokens(frame: DataFrame, token: str = "token") -> DataFrame:
    """``frame`` with the number and the folded unit of an amount text.

    Both are null if the text has no such shape; a unit stands before or behind
    the number, not both. Separate projections keep each expression single.
    """
    c = F.col
    step = frame.withColumn("_text", F.regexp_replace(token, rf"^[{BLANK}]+|[{BLANK}]+$", ""))
    step = step.withColumn("_p", F.when(c("_text").rlike(_SPLIT), F.split(F.regexp_replace("_text", _SPLIT, "$1\u0001$2\u0001$3"), "\u0001")))
    step = step.withColumn("_p", F.when((F.get("_p", F.lit(0)) == "") | (F.get("_p", F.lit(2)) == ""), c("_p")))
    return step.withColumn("number", F.get("_p", F.lit(1))).withColumn("unit", fold_unit(F.concat(F.get("_p", F.lit(0)), F.get("_p", F.lit(2))))).drop("_text", "_p")


def to_sats(frame: DataFrame, number: str = "number", sats: str = "sats", out: str = "value") -> DataFrame:
    """``frame`` with whole satoshis of a number in a unit of ``sats`` satoshis.

    Blanks and apostrophes group by threes. A comma groups if a point follows, if
    there are several, or if the unit has no fractions and three digits follow;
    otherwise a single comma is the decimal mark. Several points are no number.
    The value is null if unreadable, negative, finer than a satoshi or beyond the
    64 bits of the result. Units are powers of ten, so the conversion moves the
    point in the digits, however many there are, and never rounds.
    """
    c = F.col
    commas = r"^[+\-]?[0-9]{1,3}(,[0-9]{3})+"
    step = frame.withColumn("_s", F.regexp_replace(number, r"\u2212", "-"))
    step = step.withColumn("_s", F.when(c("_s").rlike(rf"^[+\-]?[0-9]{{1,3}}({GROUP}[0-9]{{3}})+([.,][0-9]+)?$"), F.regexp_replace("_s", GROUP, "")).otherwise(c("_s")))
    step = step.withColumn(
        "_s",
        F.when(~c("_s").contains(","), c("_s"))
        .when(c("_s").rlike(commas + r"\.[0-9]+$") | c("_s").rlike(r"^[+\-]?[0-9]{1,3}(,[0-9]{3}){2,}$"), F.translate("_s", ",", ""))
        .when((c(sats) == 1) & c("_s").rlike(commas + "$"), F.translate("_s", ",", ""))
        .when(c("_s").rlike(r"^[+\-]?[0-9]*,[0-9]+([eE][+\-]?[0-9]+)?$"), F.translate("_s", ",", ".")),
    )
    # sign, whole digits, fraction digits, exponent
    form = r"^([+\-]?)([0-9]*)[.]?([0-9]*)(?:[eE]([+\-]?[0-9]+))?$"
    step = step.withColumn("_f", F.when(c("_s").rlike(r"^[+\-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+\-]?[0-9]+)?$"), F.split(F.regexp_replace("_s", form, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")))
    step = step.withColumn("_w", F.regexp_replace(c("_f")[1], "^0+", ""))
    # digits without outer zeros, and the place of the point among them
    step = step.withColumn("_r", F.concat("_w", c("_f")[2]))
    step = step.withColumn("_g", F.regexp_replace("_r", "^0+", ""))
    exponent = F.when(c("_f")[3] == "", 0).otherwise(F.coalesce(c("_f")[3].try_cast("int"), F.when(c("_f")[3].startswith("-"), -1_000_000_000).otherwise(1_000_000_000)))
    step = step.withColumn("_x", (F.length("_w") - (F.length("_r") - F.length("_g")) + exponent.cast("long") + F.length(c(sats).cast("string")) - 1))
    step = step.withColumn("_g", F.regexp_replace("_g", "0+$", ""))
    whole = F.when(c("_g") == "", F.lit(0).cast("long")).when((c("_f")[0] != "-") & (F.length("_g") <= c("_x")) & (c("_x") <= 19), F.rpad("_g", F.least(c("_x"), F.lit(19)).cast("int"), F.lit("0")).try_cast("long"))
    return step.withColumn(out, F.when(c(sats).isNotNull(), whole)).drop("_s", "_f", "_w", "_r", "_g", "_x")


def observer_key(observer: Column) -> Column:
    """A key that is never null: empty for no observer, else marked."""
    return F.coalesce(F.concat(F.lit("="), observer), F.lit("")).alias("observer_key")


def total_in_sats(sealed: DataFrame, observers: DataFrame, amounts: str = "output_amounts", out: str = "total_out_sats") -> DataFrame:
    """(row_id, total) of every row all of whose amounts can be read.

    The unit of a token comes from the token, else the observer's unit column,
    else its note, else the observer's bare numbers (fractions, if no fewer than
    whole ones: bitcoin, else satoshi). A unit text in the token that names no unit makes it unreadable.
    Rows with a null list, a null or an unreadable amount are left out; an empty
    list totals 0. Repeated rows (other row_id) keep one output row each; an
    unknown or null observer is judged by its bare numbers; repeated observers
    take the smallest unit and note. Empty tables give an empty result.
    """
    exploded = sealed.select("row_id", "observer_id", F.explode_outer(amounts).alias("token"), F.size(amounts).alias("_n")).where(F.col("_n") >= 0)
    # every token is parsed once; the table has only numbers and unit texts
    tokens = durable(split_tokens(exploded).select("row_id", observer_key(F.col("observer_id")), "_n", "number", "unit"), "tokens")

    # one pass over them gives the distinct spellings and the observers' habits, both combined map-side
    bare = F.coalesce(F.col("unit") == "", F.lit(False))
    # only numbers of a plain shape tell a habit: 12.3.4 is neither whole nor a fraction
    fraction = bare & F.col("number").rlike(r"^[0-9]*([.][0-9]+|,([0-9]{1,2}|[0-9]{4,}))([eE][+\-]?[0-9]+)?$")
    whole = bare & F.col("number").rlike(rf"^[0-9]+$|^[0-9]{{1,3}}(({GROUP}|,)[0-9]{{3}})+$")
    facts = durable(tokens.where(F.col("unit").isNotNull()).groupBy("observer_key", "unit").agg(F.count_if(fraction).alias("fractions"), F.count_if(whole).alias("wholes")), "unit-facts")
    observers = observers.where(F.col("observer_id").isNotNull()).groupBy("observer_id").agg(F.min("amount_unit").alias("amount_unit"), F.min("note").alias("note"))
    observers = durable(observers, "observers")
    own = observers.select("observer_id", fold_unit(F.col("amount_unit")).alias("spelling"))
    words = note_words(observers)
    aliases = durable(alias_dictionary(facts.select(F.col("unit").alias("spelling")).union(own.select("spelling")).union(words.select("spelling"))), "unit-aliases")
    habits = facts.where(F.col("unit") == "").select("observer_key", F.when((F.col("fractions") > 0) & (F.col("fractions") >= F.col("wholes")), 100_000_000).otherwise(1).cast("long").alias("habit_sats"))
    told = own.join(aliases, "spelling", "left").select("observer_id", F.col("sats").alias("own_sats")).join(note_units(words, aliases), "observer_id", "left")
    told = told.select(observer_key(F.col("observer_id")), "own_sats", "note_sats")
    default = F.coalesce("own_sats", "note_sats", "habit_sats")
    # the dictionary resolved per (observer, unit text): one join instead of two
    resolved = (
        facts.select("observer_key", "unit")
        .join(habits, "observer_key", "left")
        .join(told, "observer_key", "left")
        .join(aliases.select(F.col("spelling").alias("unit"), "sats"), "unit", "left")
        .select("observer_key", "unit", F.when(F.col("unit") == "", default).otherwise(F.col("sats")).alias("sats"))
        .where(F.col("sats").isNotNull())
        .groupBy("observer_key", "unit")
        .agg(F.min("sats").alias("sats"))
    )
    resolved = small(durable(resolved, "unit-dictionary"))
    read = tokens.join(resolved, ["observer_key", "unit"], "left")
    read = to_sats(read)
    value = F.when(F.col("_n") == 0, F.lit(0)).otherwise(F.col("value"))
    # the tokens of a row sit in one partition, so partial sums leave one small row each before the shuffle
    return (
        read.groupBy("row_id")
        .agg(F.try_sum(value).alias(out), F.count(value).alias("_ok"), F.max(F.greatest("_n", F.lit(1))).alias("_n"))
        .where((F.col("_ok") == F.col("_n")) & F.col(out).isNotNull())
        .select("row_id", out)
    )


