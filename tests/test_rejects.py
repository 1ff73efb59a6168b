import random

import pytest

from peerlens.operators.rejects import COLUMNS, classify, loaded, rejected

TXID = "a1" * 32
GOOD = ["2025-01-02T03:04:05Z", "198.18.0.1", "192.0.2.1", "8333", "8333", TXID, "in1|in2", "5|6", "out1", "10", "DE", "64500", "1", "140", "p2wpkh", "880000", "inv", "obs-01"]


def line(**change):
    return ",".join(change.get(c, v) for c, v in zip(COLUMNS, GOOD, strict=True))


CASES = [
    (line(), None),
    (line(timestamp="1735690000"), None),
    (line(timestamp='" 2025-01-02 03:04:05.5+01:00 "'), None),
    (line(observer_id='"north, rack ""2""\nsecond"'), None),
    (line(input_addresses="", input_amounts=""), None),
    (line(geo_country=" ", asn="", fee_sats="-3"), None),
    (line() + " ", None),
    (line(observer_id='"x'), "broken_quoting"),
    (line(observer_id='a"b'), "broken_quoting"),
    (line(src_ip='"a"b'), "broken_quoting"),
    (line() + ",", "wrong_column_count"),
    ("one,two", "wrong_column_count"),
    (line(src_ip="  "), "missing_required_value"),
    (line(dst_port='""'), "missing_required_value"),
    (line(txid=TXID.upper()), "txid_malformed"),
    (line(timestamp="2025-02-30T00:00:00"), "timestamp_unparseable"),
    (line(timestamp="2025-01-02"), "timestamp_unparseable"),
    (line(timestamp="noon", asn="x"), "timestamp_unparseable"),
    (line(asn="64500.0"), "integer_unparseable"),
    (line(block_height="8e5"), "integer_unparseable"),
    (line(input_amounts="5|x"), "amount_unparseable"),
    (line(output_amounts="10|"), "amount_unparseable"),
    (line(input_amounts="5"), "input_length_mismatch"),
    (line(output_addresses="a|b"), "output_length_mismatch"),
    (line(output_addresses="", output_amounts=""), "no_outputs"),
    (line(observer_id="z" * 300_000), None),
    (line(observer_id='"' + '""' * 100_000 + '"'), None),
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, "f.csv", i + 1, text, "extra") for i, (text, _) in enumerate(CASES)]
    rows += [(900, "f.csv", 0, ",".join(COLUMNS), ""), (901, "f.csv", 99, "  \t", ""), (902, "f.csv", 98, None, ""), (903, "f.csv", 97, line(txid="x"), ""), (904, "f.csv", 96, line(txid="x"), "")]
    return spark.createDataFrame(rows, "line_id long, source_file string, line_no int, line string, reject_reason_old string")


@pytest.fixture(scope="module")
def reasons(lines):
    return {r["line_id"]: r["reject_reason"] for r in rejected(lines).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(reasons, i):
    assert reasons.get(i) == CASES[i][1]


def test_headers_blanks_and_repeats(reasons):
    assert {k: v for k, v in reasons.items() if k >= 900} == {903: "txid_malformed", 904: "txid_malformed"}


def test_every_line_is_loaded_or_rejected(lines, reasons):
    assert loaded(lines).count() + len(reasons) == len(CASES) + 2


def test_first_broken_field(spark):
    df = spark.createDataFrame([(line(txid="x"),), (line(asn="q"),), (line(),)], "line string")
    assert [r["first_broken"] for r in classify(df).collect()] == ["txid", "asn", None]


def test_other_column_order(spark):
    order = list(reversed(COLUMNS))
    rows = [(1, "g.csv", 0, ",".join(order)), (2, "g.csv", 1, ",".join(reversed(GOOD))), (3, "g.csv", 2, line())]
    df = spark.createDataFrame(rows, "line_id long, source_file string, line_no int, line string")
    assert {r["line_id"]: r["reject_reason"] for r in rejected(df).collect()} == {3: "txid_malformed"}
    assert loaded(df).first()["txid"] == TXID


def test_a_hundred_header_orders_in_one_plan(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for f in range(100):
        at = rng.sample(range(18), 18)
        rows.append((f * 10, f"f{f}.csv", 0, ",".join(COLUMNS[i].upper() for i in at)))
        for k, (text, reason) in enumerate(rng.sample(CASES[:25], 4)):
            cells = [c for c in text.split(",")]
            if '"' in text or len(cells) != 18:
                continue
            rows.append((f * 10 + k + 1, f"f{f}.csv", k + 1, ",".join(cells[i] for i in at)))
            want[f * 10 + k + 1] = reason
    df = spark.createDataFrame(rows, "line_id long, source_file string, line_no int, line string")
    got = rejected(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") + got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    assert {r["line_id"]: r["reject_reason"] for r in got.collect()} == {k: v for k, v in want.items() if v}
    assert loaded(df).where(f"txid = '{TXID}'").count() == sum(v is None for v in want.values())


def test_empty(spark):
    assert rejected(spark.createDataFrame([], "line_id long, source_file string, line_no int, line string")).count() == 0
