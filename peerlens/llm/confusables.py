"""Texts that look the same brought to one form (problem 10).

Invisible characters go, kinds of blank become the space, width forms and joined
letters take their plain letters, and separate accents join their letters. Then
each token's letters are resolved: every letter stands for a class of look-alikes
with members in several scripts; intersecting the scripts of all letters of the
token finds the scripts in which it can be spelled as a whole (mixed-script and
whole-script confusables alike), and the token is respelled in the first of them.
As the choice depends on the classes only, all texts that look the same get one
form. Letter case, accents, digits, punctuation and line breaks stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from peerlens.runtime import discard, durable, hot_keys, ship, skew_join

# Letters of several scripts that look alike, one class a line, plain letter first.
LOOKALIKES = """
A А Α Ꭺ
B В Β
C С Ϲ Ⅽ
D Ꭰ Ⅾ
E Е Ε Ꭼ
F Ϝ Ғ
G Ԍ Ꮐ
H Н Η Ꮋ
I І Ι Ӏ Ⅰ
J Ј Ϳ Ꭻ
K К Κ K
L Ꮮ Ⅼ
M М Μ Ϻ Ⅿ
N Ν
O О Ο Օ
P Р Ρ Ꮲ
Q Ԛ
S Ѕ Տ
T Т Τ Ꭲ
U Ս
V Ѵ Ꮩ Ⅴ
W Ԝ Ꮃ
X Х Χ Ⅹ
Y У Υ Ү
Z Ζ Ꮓ
a а α ɑ
c с ϲ ⅽ
d ԁ ⅾ
e е
g ɡ
h һ հ
i і ι ⅰ
j ј ϳ
l ⅼ
m ⅿ
n ո
o о ο օ
p р ρ
q ԛ զ
s ѕ
u υ ս
v ν ѵ ⅴ
w ԝ
x х χ ⅹ
y у γ ү
П Π
Ф Φ
Г Γ
ω ѡ
ε є
μ µ
"""
# Preference among the scripts in which a token can be spelled.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "OTHER")
# Resolved tokens that a worker keeps.
CACHE_TOKENS = 200_000


def script(letter: str) -> str:
    """Script of a letter by the first word of its Unicode name."""
    name = unicodedata.name(letter, "OTHER").split(" ")[0]
    return name if name in SCRIPTS else {"MICRO": "GREEK", "ROMAN": "LATIN", "KELVIN": "LATIN"}.get(name, name)


def _classes() -> dict[str, tuple[str, dict[str, str]]]:
    """Letter to (class name, script -> member)."""
    out: dict[str, tuple[str, dict[str, str]]] = {}
    for line in LOOKALIKES.split("\n"):
        if not line:
            continue
        letters = [unicodedata.normalize("NFD", x) for x in line.split(" ")]
        members: dict[str, str] = {}
        for x in letters:
            members.setdefault(script(x), x)
        for x in letters:
            out[x] = (letters[0], members)
    return out


def _plain_characters() -> dict[int, str | None]:
    """Single-character rewrites, by rule from the Unicode character database."""
    out: dict[int, str | None] = {}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cs" or kind == "Cn" or kind == "Co":
            continue
        if kind == "Zs" or c == "\t":
            if c != " ":
                out[i] = " "
        elif kind == "Cf" or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or i in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            out[i] = None  # invisible: format characters, variation selectors, fillers
        else:
            tag, _, rest = unicodedata.decomposition(c).partition(" ")
            if tag in ("<wide>", "<narrow>") or (tag == "<compat>" and ("LIGATURE" in unicodedata.name(c, "") or "DIGRAPH" in unicodedata.name(c, ""))):
                out[i] = unicodedata.normalize("NFKC", c)
    return out


@lru_cache(maxsize=1)
def _tables():
    import regex

    codes = _plain_characters()
    plain = {chr(i): rewrite or "" for i, rewrite in codes.items()}
    classes = _classes()
    token = regex.compile(r"[\p{L}\p{M}]+")
    # texts without such characters skip the step that rewrites them
    touched = re.compile("[" + "".join(c for c in sorted(classes) if not c.isascii()) + "]")
    # one range stands for all characters beyond U+FFFF: a class of mixed planes is searched slowly
    special = re.compile("[" + "".join(re.escape(chr(i)) for i in sorted(codes) if i < 0x10000) + "\U00010000-\U0010ffff]")
    return plain, classes, token, touched, special


_RESOLVED: dict[str, str] = {}


def resolve_token(token: str) -> str:
    """A token (letters and marks, decomposed) in its consistent script.

    The scripts of all letters are intersected; marks belong to any script. If
    no single script can spell the token, each letter takes the first member of
    its class.
    """
    classes = _tables()[1]
    possible: set[str] | None = None
    for c in token:
        if unicodedata.category(c)[0] == "M":
            continue
        own = set(classes[c][1]) if c in classes else {script(c)}
        possible = own if possible is None else possible & own
    chosen = next((s for s in SCRIPTS if possible and s in possible), None)
    out = []
    for c in token:
        if c not in classes:
            out.append(c)
        else:
            first, members = classes[c]
            out.append(members.get(chosen, first) if chosen else first)
    return "".join(out)


def one_form(text: str) -> str:
    """The one form of a text; equal for texts that look the same."""
    if text.isascii():
        return text.replace("\t", " ")
    plain, _, token, touched, special = _tables()
    flat = unicodedata.normalize("NFD", special.sub(lambda m: plain.get(m.group(), m.group()), text))
    if not touched.search(flat):
        return unicodedata.normalize("NFC", flat)
    if len(_RESOLVED) > CACHE_TOKENS:
        _RESOLVED.clear()

    def respell(match) -> str:
        word = match.group()
        if word.isascii():
            return word
        if word not in _RESOLVED:
            resolved = resolve_token(word)
            if len(word) > 64:
                return resolved
            _RESOLVED[word] = resolved
        return _RESOLVED[word]

    return unicodedata.normalize("NFC", token.sub(respell, flat))


@F.pandas_udf(StringType())
def one_form_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else one_form(t))


def normalised_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form): every document in the one form; null stays null."""
    return spread(documents.select(id_col, text_col)).select(id_col, one_form_column(text_col).alias("form"))


def spread(slim: DataFrame) -> DataFrame:
    """``slim`` over at least as many partitions as there are cores."""
    ship(slim.sparkSession)
    cores = slim.sparkSession.sparkContext.defaultParallelism
    return slim.repartition(cores) if slim.rdd.getNumPartitions() < cores else slim


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from hashlib import sha256

    for frame in frames:
        ids, texts = frame.iloc[:, 0], frame.iloc[:, 1]
        yield pd.DataFrame(
            {
                "doc": ids,
                "form": [sha256(one_form(t).encode("utf-8", "surrogatepass")).digest() for t in texts],
                "exact": [sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] for t in texts],
            }
        )


def look_alike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 100_000) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller id first, of unequal texts that look the same.

    Null and empty texts pair with nothing; equal texts do not pair with each
    other, but each of them pairs with every unequal look-alike. Texts are
    compared as digests of the form (32 bytes) and of the text (16 bytes). Only
    distinct spellings of a form meet, so copies of one text are never paired
    with each other, however many there are. An empty table gives no rows.
    """
    slim = documents.where(F.col(text_col).isNotNull() & (F.col(text_col) != "") & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_col)
    marks = durable(spread(slim).mapInPandas(_digests, "doc long, form binary, exact binary"), "forms")
    # forms with more than one spelling, by a map-side combined minimum and maximum
    mixed = marks.groupBy("form").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).where("lo <> hi").select("form")
    spellings = durable(skew_join(marks, mixed, "form", hot_keys(marks, "form", least=hot_rows)).select("form", "exact", "doc"), "spellings")
    kinds = durable(spellings.select("form", "exact").distinct(), "kinds")
    discard(marks)
    # a form with very many spellings, and a spelling with very many documents, are split; their pairs are the result
    many = hot_keys(kinds, "form", least=hot_rows)
    pairs = skew_join(kinds.select("form", F.col("exact").alias("a")), kinds.select("form", F.col("exact").alias("b")), "form", many).where("a < b").select("form", "a", "b")
    copies = hot_keys(spellings, ["form", "exact"], least=hot_rows)
    docs_a = spellings.select("form", F.col("exact").alias("a"), F.col("doc").alias("doc_a"))
    docs_b = spellings.select("form", F.col("exact").alias("b"), F.col("doc").alias("doc_b"))
    full = skew_join(docs_b, skew_join(docs_a, pairs, ["form", "a"], copies), ["form", "b"], copies)
    return full.select(F.least("doc_a", "doc_b").alias(f"{id_col}_a"), F.greatest("doc_a", "doc_b").alias(f"{id_col}_b")).where(F.col(f"{id_col}_a") != F.col(f"{id_col}_b"))
