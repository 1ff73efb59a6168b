import random
import statistics

from pyspark.sql import functions as F

from peerlens.operators.asof import asof_join
from peerlens.operators.ordered import exact_medians, last_before, running_total


def brute(rows, strict):
    out, last = [], {}
    for g, t, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if not strict and v is not None:
            last[g] = v
        out.append((g, t, last.get(g)))
        if v is not None:
            last[g] = v
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["h", "h", "h", "a", "b", None]), t, rng.choice([None, None, None, t])) for t in range(400)]
    rows += [("gap", t, None) for t in range(1_000, 1_200)] + [("gap", 999, 7)]
    df = spark.createDataFrame(rows, "g string, t int, v int")
    for strict in (True, False):
        for hot_rows in (10_000, 30):
            got = last_before(df, ["g"], [F.col("t").asc()], "v", "out", strict, hot_rows).select("g", "t", "out").collect()
            assert sorted(map(tuple, got), key=str) == brute(rows, strict)
    assert last_before(df.limit(0), ["g"], [F.col("t").asc()], "v", "out").count() == 0


def test_asof_with_a_hot_key(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([("h" if i % 3 else "k", rng.randrange(500), i) for i in range(300)], "k string, t int, i int")
    right = spark.createDataFrame([(rng.choice("hhk"), rng.randrange(500), n) for n in range(200)], "k string, rt int, p int")
    for direction in ("backward", "forward"):
        for strict in (True, False):
            plain, split = (sorted(map(tuple, asof_join(left, right, ["k"], "t", "rt", ["p"], direction, strict, hot_rows=n).collect()), key=str) for n in (10_000, 25))
            assert plain == split and len(plain) == 300


def test_running_totals_and_medians(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["h", "h", "h", "a", None]), i, rng.choice([None, rng.randrange(9), rng.random()])) for i in range(300)]
    df = spark.createDataFrame([(g, i, None if x is None else float(x)) for g, i, x in rows], "g string, i int, x double").withColumn("one", F.lit(1).cast("long"))
    for range_rows in (40, 10_000):
        got = {r["i"]: r["k"] for r in running_total(df, ["g"], [F.col("i").asc()], "one", "k", range_rows).collect()}
        seen = {}
        for g, i, _ in rows:
            seen[g] = seen.get(g, 0) + 1
            assert got[i] == seen[g]
        assert [r["k"] for r in running_total(df, [], [F.col("i").asc()], "one", "k", range_rows).orderBy("i").collect()] == list(range(1, 301))
        values = {}
        for g, _, x in rows:
            if x is not None:
                values.setdefault(g, []).append(float(x))
        assert {r["g"]: r["m"] for r in exact_medians(df, ["g"], "x", "m", range_rows).collect()} == {g: statistics.median(v) for g, v in values.items()}
        assert exact_medians(df, [], "x", "m", range_rows).first()["m"] == statistics.median([x for v in values.values() for x in v])
    assert exact_medians(df.limit(0), ["g"], "x", "m").count() == 0
