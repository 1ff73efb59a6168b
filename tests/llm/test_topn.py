import random

from peerlens.llm import topn
from peerlens.llm.topn import top_n

SCHEMA = "g string, e string, item string, score double, place string"


def brute(rows, n=3):
    best = {}
    for g, e, item, score, _ in rows:
        if None in (g, e, item, score) or score != score:
            continue
        group = best.setdefault((g, e), {})
        group[item] = max(score, group.get(item, float("-inf")))
    out = set()
    for (g, e), group in best.items():
        for place, (item, _) in enumerate(sorted(group.items(), key=lambda x: (-x[1], x[0]))[:n], 1):
            out.add((g, e, item, place))
    return out


def run(spark, rows, parts, n=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return [tuple(r) for r in top_n(df, ["g", "e"], "item", "score", n).collect()]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("hot", "x", f"p{rng.randrange(400)}", rng.choice([0.1, 0.5, 0.5, 0.9, rng.random(), None, float("nan")]), "") for _ in range(3000)]
    rows += [(f"g{rng.randrange(200)}", rng.choice("xy"), f"p{rng.randrange(9)}", round(rng.random(), 1), "") for _ in range(2000)]
    rows += [(None, "x", "p", 1.0, ""), ("g", None, "p", 1.0, ""), ("g", "x", None, 1.0, ""), ("z", "x", "a", -0.0, ""), ("z", "x", "b", 0.0, ""), ("i", "x", "inf", float("inf"), ""), ("L", "x", "q" * 50_000, 1.0, "")]
    rows += rows[:500]
    for parts in (1, 7):
        for n in (1, 3):
            got = run(spark, rows, parts, n)
            assert len(got) == len(set(got))
            assert set(got) == brute(rows, n)
    for bounds in (0, 1):  # no bound or only the most widely held group's is known before the exchange
        monkeypatch.setattr(topn, "BOUNDS", bounds)
        assert set(run(spark, rows, 5)) == brute(rows)
    monkeypatch.setattr(topn, "COMPACT_ROWS", 10)
    assert set(run(spark, rows, 3)) == brute(rows)


def test_bounds_drop_rows_before_the_exchange(spark):
    rows = [("hot", "x", f"p{i}", float(i), "") for i in range(2_000)]
    df = top_n(spark.createDataFrame(rows, SCHEMA).repartition(8), ["g", "e"], "item", "score")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("Join LeftOuter")  # the join lies below, so it runs first
    assert [r["item"] for r in df.orderBy("place").collect()] == ["p1999", "p1998", "p1997"]


def test_empty(spark):
    assert run(spark, [], 1) == []
    assert run(spark, [("g", "x", "p", None, "")], 1) == []
