import pytest

from peerlens.operators.units import alias_dictionary, total_in_sats, weighted_distance

SCHEMA = "row_id long, observer_id string, output_amounts array<string>, unit string"
OBSERVERS = [
    ("sat", "sats", None), ("btc", "XBT", "rack 3"), ("note-milli", None, "figures are thousandths of a bitcoin"), ("note-micro", None, "counts micro-bitcoin since build 54"),
    ("note-sat", None, "amount fields hold satoshi, see sheet 84"), ("note-btc", None, "unit: bitcoin (revision 51)"), ("whole", None, "rack 38, north hall"), ("fraction", None, None), ("typo", "satohsi", None), ("typo2", "mili-bitcoin", None), ("note-typo", None, "figures are thousanths of a bitcoin"), ("", "btc", None),
]
CASES = [
    ("sat", ["5"], 5), ("sat", ["5", "7"], 12), ("btc", ["0.00000001"], 1), ("btc", ["1"], 100_000_000), ("note-milli", ["1.5"], 150_000), ("note-micro", ["2"], 200), ("note-sat", ["9"], 9), ("note-btc", ["2.5"], 250_000_000),
    ("whole", ["41"], 41), ("whole", ["12.3.4"], None), ("whole", ["7"], 7), ("fraction", ["12.3.4"], None), ("fraction", ["0.5"], 50_000_000), ("typo", ["3"], 3), ("typo2", ["1"], 100_000),
    ("sat", ["0.5 BTC"], 50_000_000), ("sat", ["₿0.1"], 10_000_000), ("sat", ["XBT 0.2"], 20_000_000), ("sat", ["2.5 ksat"], 2_500), ("btc", ["3 bits"], 300), ("btc", ["2,354.17 bits"], 235_417), ("sat", ["1.5 µBTC"], 150), ("sat", ["1.5 μBTC"], 150),
    ("btc", ["5 260 956 sat"], 5_260_956), ("btc", ["793'869 sat"], 793_869), ("btc", ["5 260 sats"], 5_260), ("btc", ["958,208 sat"], 958_208), ("sat", ["0,02943149 BTC"], 2_943_149), ("sat", ["5.329851000e-02 BTC"], 5_329_851),
    ("btc", ["0.5000000000000000000000000"], 50_000_000), ("sat", ["00000000000000000000000000005"], 5), ("sat", ["5e0000000001"], 50), ("btc", ["5000000000000000000e-0000000020"], 5_000_000), ("sat", ["0e99999999999"], 0),
    ("sat", ["9223372036854775807"], 9223372036854775807), ("btc", ["12345678901.00000001"], 1_234_567_890_100_000_001), ("sat", ["5 " + "-".join("satoshi") + "-" * 40], None), ("sat", ["3 " + "satoshi" + "-" * 40], 3),
    ("note-typo", ["2"], 200_000), ("", ["0.25"], 25_000_000), ("sat", [" 7 Satoshis "], 7), ("sat", ["1.0000000000000000 BTC"], 100_000_000), ("sat", [], 0),
    # unreadable: the row is left out
    ("sat", ["0.5"], None), ("btc", ["0.000000001"], None), ("sat", ["-5"], None), ("sat", ["1", None], None), ("sat", None, None), ("sat", ["12.3.4"], None), ("sat", ["1e"], None), ("sat", ["0x1f"], None),
    ("sat", ["9223372036854775808"], None), ("sat", ["9223372036854775807", "1"], None), ("sat", ["1e400"], None), ("btc", ["1e-99999999999"], None), ("sat", ["n/a"], None), ("sat", ["5 parsecs"], None), ("sat", [""], None), ("sat", ["BTC 5 sat"], None), ("sat", ["1,2,3 sat"], None), ("sat", ["9" * 100_000], None), ("sat", ["5 msat"], None),
]


@pytest.fixture(scope="module")
def result(spark):
    sealed = spark.createDataFrame([(i, o, a, "clash") for i, (o, a, _) in enumerate(CASES)], SCHEMA)
    observers = spark.createDataFrame(OBSERVERS, "observer_id string, amount_unit string, note string")
    return {r["row_id"]: r["total_out_sats"] for r in total_in_sats(sealed, observers).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(result, i):
    assert result.get(i) == CASES[i][2]


def test_empty_and_unknown_observer(spark):
    observers = spark.createDataFrame([], "observer_id string, amount_unit string, note string")
    assert total_in_sats(spark.createDataFrame([], SCHEMA), observers).count() == 0
    rows = spark.createDataFrame([(1, None, ["3"], ""), (2, "x", ["0.5", "1"], "")], SCHEMA)
    got = {r["row_id"]: r["total_out_sats"] for r in total_in_sats(rows, observers).collect()}
    assert got == {1: 3, 2: 150_000_000}


def test_dictionary(spark):
    words = ["satoshi", "satoshis", "satohsi", "milibitcoin", "mbtc", "btc", "xyz", "nan", "north", "hall", "unknown", "overflow", "msat", "rack", "build", "sheet", "bitcoin"]
    got = {r["spelling"]: r["sats"] for r in alias_dictionary(spark.createDataFrame([(w,) for w in words], "spelling string")).where("sats is not null").collect()}
    assert got == {"satoshi": 1, "satoshis": 1, "satohsi": 1, "milibitcoin": 100_000, "mbtc": 100_000, "btc": 100_000_000, "bitcoin": 100_000_000}


def test_scale_letter_is_never_a_typo():
    assert weighted_distance("mbtc", "ubtc") > 1
    assert weighted_distance("btc", "mbtc") > 1
    assert weighted_distance("sat", "ksat") > 1
