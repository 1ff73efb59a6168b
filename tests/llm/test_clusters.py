import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from peerlens.llm.clusters import _arcs, _grow, decompose, groups
from peerlens.runtime import hot_keys

SCHEMA = "a string, b string, address string"


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def run(spark, pairs, one_task_edges=0, **more):
    got = groups(spark.createDataFrame([(a, b, "clash") for a, b in pairs], SCHEMA), one_task_edges=one_task_edges, **more).collect()
    assert len({r["address"] for r in got}) == len(got)
    return {r["address"]: r["cluster_id"] for r in got}


def test_chain_star_hub_and_noise(spark):
    rng = random.Random(1)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("hub", f"s{i}") for i in range(200)]
    loose = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(120)]
    pairs = chain + star + loose + star + [(None, "x"), ("x", None), ("self", "self"), ("b", "a"), ("a", "b"), ("", "é" * 50_000)]
    rng.shuffle(pairs)
    assert run(spark, pairs, 100_000) == brute(pairs)
    assert run(spark, pairs, 20, hot_rows=5) == brute(pairs)  # the hub is split
    assert run(spark, pairs, 50, hot_rows=5, numbered=True) == brute(pairs)


def test_plan_grows_linearly_with_a_hot_vertex(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)], "u long, v long")
    hot = hot_keys(_arcs(edges), "v", least=5)
    joins = [_grow(edges, 0, 0.2, n, hot)._jdf.queryExecution().optimizedPlan().toString().count("Join ") for n in (2, 4, 6)]
    assert joins[2] - joins[1] == joins[1] - joins[0] <= 6


def test_a_third_of_all_claims_on_one_address(spark):
    pairs = [("hub", f"s{i}") for i in range(3_000)] + [(f"a{i}", f"a{i + 1}") for i in range(0, 6_000, 2)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    assert run(spark, pairs, 2_000, hot_rows=500) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None), ("a", "a")]) == {}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40), st.floats(0.1, 2.0), st.integers(1, 4))
def test_any_shift_rate_and_rounds_are_exact(spark, pairs, beta, rounds):
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {r["v"]: r["root"] for r in decompose(df, beta, rounds, one_task_edges=len(pairs) % 3 * 5).collect()}
    want = brute(pairs)
    assert got.keys() == want.keys()
    assert len({(got[k], want[k]) for k in got}) == len(set(got.values())) == len(set(want.values()))
