import random

from peerlens.operators.components import components


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def run(spark, pairs, **more):
    rows = components(spark.createDataFrame(pairs, "src string, dst string"), **more).collect()
    assert len({r["member"] for r in rows}) == len(rows)
    return {r["member"]: r["root"] for r in rows}


def test_all_ways_agree_with_brute_force(spark):
    rng = random.Random(6)
    pairs = [("hub", f"s{i}") for i in range(300)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)] + [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(100)] + [(None, "x"), ("y", "y"), ("b", "a"), ("a", "b")]
    want = brute(pairs)
    assert run(spark, pairs) == want  # one task
    assert run(spark, pairs, one_task_edges=0, hot_rows=50) == want  # stars with a split hub
    assert run(spark, pairs, numbered=True) == want
    assert run(spark, [(None, None), ("a", "a")]) == {}
