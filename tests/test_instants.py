import datetime as dt

import pytest

from peerlens.operators.instants import instant_dictionary, normalise_instants

US = 1_000_000


def us(*args):
    return int(dt.datetime(*args, tzinfo=dt.timezone.utc).timestamp()) * US


CASES = [
    ("1735691510.574949", "UTC", None, 1735691510574949),
    ("1735691510", "Asia/Tokyo", "DMY", 1735691510 * US),
    ("1735691510123", "UTC", None, 1735691510123000),
    ("1735691510123456", "UTC", None, 1735691510123456),
    ("1735691510123456789", "UTC", None, 1735691510123456),
    ("20250101T060007", "Europe/Berlin", None, us(2025, 1, 1, 5, 0, 7)),
    ("2025-01-01T00:44:49.404100", "Asia/Kolkata", None, us(2024, 12, 31, 19, 14, 49) + 404100),
    ("2025-01-01T07:29:02.517055999+05:45", "UTC", None, us(2025, 1, 1, 1, 44, 2) + 517055),
    ("2025-01-01 04:43:55,445-0500", "UTC", None, us(2025, 1, 1, 9, 43, 55) + 445000),
    ("2025-01-01 03:49:14+01", "UTC", None, us(2025, 1, 1, 2, 49, 14)),
    ("\t2025-01-01T04:27:51Z ", "Asia/Tokyo", None, us(2025, 1, 1, 4, 27, 51)),
    ("2024-12-31 20:48:39.930543 EST", "UTC", None, us(2025, 1, 1, 1, 48, 39) + 930543),
    ("2025-01-01T11:24:05[Asia/Tokyo]", "UTC", None, us(2025, 1, 1, 2, 24, 5)),
    ("2025-07-01T11:24:05-04:00[America/New_York]", "UTC", None, us(2025, 7, 1, 15, 24, 5)),
    ("10/1/2025 00:46:50", "UTC", "DMY", us(2025, 1, 10, 0, 46, 50)),
    ("1/10/2025 2:13:58 AM", "America/Chicago", "MDY", us(2025, 1, 10, 8, 13, 58)),
    ("12/31/2024 12:15:07 PM", "UTC", "MDY", us(2024, 12, 31, 12, 15, 7)),
    ("01.02.2025 19:55:12.085019", "Europe/Berlin", "DMY", us(2025, 2, 1, 18, 55, 12) + 85019),
    ("31 Dec 2024 21:17:59.677539", "UTC", None, us(2024, 12, 31, 21, 17, 59) + 677539),
    ("Fri, 10 Jan 2025 05:46:47 +1030", "UTC", None, us(2025, 1, 9, 19, 16, 47)),
    ("Wed, 01 Jan 2025 05:16:45 GMT", "Asia/Tokyo", None, us(2025, 1, 1, 5, 16, 45)),
    # a local time that occurs twice is the earlier instant; a skipped one takes the offset before
    ("2025-10-26T02:30:00", "Europe/Berlin", None, us(2025, 10, 26, 0, 30, 0)),
    ("2025-03-30T02:30:00", "Europe/Berlin", None, us(2025, 3, 30, 1, 30, 0)),
    ("2025-04-06T01:45:00", "Australia/Lord_Howe", None, us(2025, 4, 5, 14, 45, 0)),
    ("25:61:07", "UTC", None, None),
    ("2025-13-01T00:00:00", "UTC", None, None),
    ("2025-02-30T00:00:00", "UTC", None, None),
    ("2025-01-01T25:00:00", "UTC", None, None),
    ("2025-01-01T00:00:00 XYZ", "UTC", None, None),
    ("31/31/2025 00:00:00", "UTC", "DMY", None),
    ("13/10/2025 1:00:00 XM", "UTC", "DMY", None),
    ("not synced", "UTC", None, None),
    ("", "UTC", None, None),
    (None, "UTC", None, None),
    ("x" * 200_000, "UTC", None, None),
]


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, raw, f"o{i}", "extra") for i, (raw, *_) in enumerate(CASES)]
    observers = [(f"o{i}", tz, order, 1) for i, (_, tz, order, _) in enumerate(CASES)]
    sealed = spark.createDataFrame(rows, "row_id long, ts_raw string, observer_id string, raw string")
    obs = spark.createDataFrame(observers, "observer_id string, tz string, date_order string, row_id int")
    return {r["row_id"]: r["ts_us"] for r in normalise_instants(sealed, obs).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(result, i):
    assert result.get(i) == CASES[i][3]


def test_empty_null_observer_and_repeats(spark):
    schema = "row_id long, ts_raw string, observer_id string"
    obs = spark.createDataFrame([("a", "Asia/Tokyo", None), ("a", "Asia/Tokyo", None), (None, "UTC", None)], "observer_id string, tz string, date_order string")
    assert normalise_instants(spark.createDataFrame([], schema), obs).count() == 0
    same = [(1, "2025-01-01T00:00:00", None), (2, "2025-01-01T00:00:00", "a"), (3, "2025-01-01T00:00:00", "a"), (4, "2025-01-01T00:00:00", "unknown")]
    got = {r["row_id"]: r["ts_us"] for r in normalise_instants(spark.createDataFrame(same, schema), obs).collect()}
    assert got == {1: us(2025, 1, 1), 4: us(2025, 1, 1), 2: us(2024, 12, 31, 15), 3: us(2024, 12, 31, 15)}


def test_dictionary_grows(spark, tmp_path):
    schema = "row_id long, ts_raw string, observer_id string"
    obs = spark.createDataFrame([("a", "UTC", None)], "observer_id string, tz string, date_order string")
    path = str(tmp_path / "dictionary")
    a = spark.createDataFrame([(1, "1735691510", "a"), (2, "no time", "a")], schema)
    b = spark.createDataFrame([(3, "1735691510", "a"), (4, "1735691511", "a")], schema)
    assert normalise_instants(a, obs, path).count() == 1
    assert normalise_instants(b, obs, path).count() == 2
    assert spark.read.parquet(path).count() == 3  # nothing was parsed twice
    # both results in one plan see their own state of the dictionary
    fresh = str(tmp_path / "fresh")
    first, second = normalise_instants(a, obs, fresh), normalise_instants(b, obs, fresh)
    assert sorted(r["row_id"] for r in first.unionByName(second).collect()) == [1, 3, 4]


def test_text_that_becomes_hot_later_is_split(spark, tmp_path):
    schema = "row_id long, ts_raw string, observer_id string"
    obs = spark.createDataFrame([("a", "UTC", None)], "observer_id string, tz string, date_order string")
    path = str(tmp_path / "dictionary")
    assert normalise_instants(spark.createDataFrame([(1, "1735691510", "a")], schema), obs, path).count() == 1
    later = normalise_instants(spark.createDataFrame([(i, "1735691510", "a") for i in range(90)] + [(99, "1735691511", "a")], schema), obs, path, hot_rows=30)
    assert "_salt" in later._jdf.queryExecution().optimizedPlan().toString()
    assert later.count() == 91 and spark.read.parquet(path).count() == 2


def test_dictionary_is_distinct(spark):
    rows = spark.createDataFrame([("1735691510", None, None)] * 5, "raw string, zone string, date_order string")
    assert instant_dictionary(rows).count() == 1


def test_hot_texts_take_the_broadcast(spark):
    obs = spark.createDataFrame([("a", "UTC", None)], "observer_id string, tz string, date_order string")
    rows = [(i, "1735691510" if i % 2 else f"17356915{i:02d}", "a") for i in range(60)] + [(99, "pending", "a")]
    df = spark.createDataFrame(rows, "row_id long, ts_raw string, observer_id string")
    plain, hot = (sorted(tuple(r) for r in normalise_instants(df, obs, hot_rows=n).collect()) for n in (1000, 5))
    assert plain == hot and len(hot) == 60
