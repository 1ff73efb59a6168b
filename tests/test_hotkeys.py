import random

from peerlens.operators import hotkeys
from peerlens.operators.hotkeys import hot_key_share, lower_medians

SCHEMA = "run string, key string, value string, mid_value string"


def brute(rows):
    groups = {}
    for run, key, value, _ in rows:
        if None not in (run, key, value):
            groups.setdefault((run, key), set()).add(value)
    return {k: sorted(v)[(len(v) + 1) // 2 - 1] for k, v in groups.items()}


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("r", "hot", f"{rng.randrange(3000):05d}", "x") for _ in range(4000)]
    rows += [("r", f"k{rng.randrange(300)}", f"{rng.randrange(99)}", "x") for _ in range(3000)]
    rows += [(None, "a", "1", "x"), ("r", None, "1", "x"), ("r", "n", None, "x"), ("", "", "", "x"), ("q", "hot", "é", "x"), ("q", "hot", "z", "x"), ("q", "hot", "L" * 100_000, "x")]
    for partitions in (1, 3, 16):  # the hot key spans many ranges
        got = {(r["run"], r["key"]): r["mid_value"] for r in lower_medians(spark.createDataFrame(rows, SCHEMA), ["run", "key"], "value", partitions=partitions).collect()}
        assert got == brute(rows)


def test_one_key_only_and_empty(spark):
    rows = [("r", "k", str(i), "") for i in range(500)]
    got = lower_medians(spark.createDataFrame(rows, SCHEMA), ["run", "key"], "value", partitions=7).collect()
    assert [r["mid_value"] for r in got] == [brute(rows)["r", "k"]]
    assert lower_medians(spark.createDataFrame([], SCHEMA), ["run", "key"], "value").count() == 0


def test_keys_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "TABLE_ROWS", 50)
    rng = random.Random(5)
    rows = [("r", rng.choice("aabbbbbbc") + str(rng.randrange(3)), f"{rng.randrange(900):04d}", "") for _ in range(5_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for partitions in (1, 4):
            df2 = lower_medians(df, ["run", "key"], "value", partitions=partitions)
            assert {(r["run"], r["key"]): r["mid_value"] for r in df2.collect()} == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_combining_is_bounded_and_loses_nothing():
    batches = [hotkeys.pa.RecordBatch.from_pydict({"k": ["h"] * 90_000, "v": [str(i % 7 + k * 1_000) for i in range(90_000)]}) for k in range(6)]
    out = list(hotkeys.combine(iter(batches)))
    assert sum(b.num_rows for b in out) == 42
    assert list(hotkeys.combine(iter([]))) == []


def test_share(spark):
    got = hot_key_share(spark.createDataFrame([("a", "x", None, None)] * 3 + [("a", None, None, None)], SCHEMA), ["run", "key"]).collect()
    assert {r["key"]: (r["n_rows"], r["share"]) for r in got} == {"x": (3, 0.75), None: (1, 0.25)}
    assert hot_key_share(spark.createDataFrame([], SCHEMA), ["run"]).count() == 0
