import unicodedata

import pytest

from peerlens.llm.confusables import look_alike_pairs, normalised_texts, one_form, resolve_token

SCHEMA = "doc_id long, text string, form string"
SAME = [
    ("Alert 5", "Аlеrt 5"),  # Cyrillic letters
    ("Zone", "Ζοne"),  # Greek letters
    ("office flow", "oﬃce ﬂow"),
    ("data 12", "ｄａｔａ １２"),
    ("naïve Zürich", unicodedata.normalize("NFD", "naïve Zürich")),
    ("a b c", "a b c"),
    ("zero width", "ze​ro﻿ wid­th⁠"),
    ("ガード", "ｶﾞｰﾄﾞ"),
    ("сор", "cop"),  # the whole word can be either script
    ("Москва", "Mоcква"),  # spelled in the only script that has all its letters
    ("tag", "taɡ"),
]
DIFFERENT = [("Alert", "alert"), ("resume", "résumé"), ("a 1", "a 2"), ("a b", "a  b"), ("a\nb", "a b"), ("a.b", "a,b"), ("O", "0"), ("l", "1"), ("x²", "x2"), ("½", "1/2"), ("жа", "xa")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_form(a, b):
    assert one_form(a) == one_form(b)
    assert one_form(one_form(b)) == one_form(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_visible_difference(a, b):
    assert one_form(a) != one_form(b)


def test_consistent_script():
    assert resolve_token("Mоcква") == "Москва"
    assert resolve_token("рау") == "pay"


def test_pairs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(x for pair in SAME for x in pair)]
    rows += [(100, None, ""), (101, "", ""), (102, "", ""), (103, "​", ""), (104, "plain", ""), (105, "plain", ""), (106, "Alert 5", ""), (107, "x" * 300_000, ""), (108, "х" * 300_000, "")]
    got = [tuple(r) for r in look_alike_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    want = {(2 * i, 2 * i + 1) for i in range(len(SAME))} | {(1, 106), (107, 108)}
    assert set(got) == want  # equal texts (0 and 106, 104 and 105) do not pair


def test_copies_never_meet_each_other(spark):
    rows = [(i, "pay", "") for i in range(300)] + [(1000, "раy", ""), (1001, "рay", "")]
    got = look_alike_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 601


def test_hot_forms_and_spellings_are_split(spark):
    spellings = ["pay", "раy", "рay", "pаy", "paу", "рaу", "раyу"[:3], "p​ay", "ｐａｙ"]
    rows = [(i, spellings[0] if i % 3 else spellings[1 + i % 8], "") for i in range(240)] + [(1_000, "other", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    plain, split = (sorted(map(tuple, look_alike_pairs(df, hot_rows=n).collect())) for n in (100_000, 4))
    texts = {i: t for i, t, _ in rows}
    assert plain == split == sorted((a, b) for a in range(240) for b in range(a + 1, 240) if texts[a] != texts[b])


def test_empty_and_forms(spark):
    assert look_alike_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    got = {r["doc_id"]: r["form"] for r in normalised_texts(spark.createDataFrame([(1, None, ""), (2, "ａ\tb", "")], SCHEMA)).collect()}
    assert got == {1: None, 2: "a b"}
