import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from peerlens.operators import asof, graph, peel
from peerlens.operators.components import components
from peerlens.operators.origin import fallback_ensemble, finalise, first_spy


def test_components_against_union_find(spark):
    rng = random.Random(2)
    pairs = [(f"v{rng.randrange(80)}", f"v{rng.randrange(80)}") for _ in range(60)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(60)] + [(None, "x"), ("x", "x")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["member"]: r["root"] for r in components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_clusters_threshold_and_numbers(spark):
    e = spark.createDataFrame([("b", "c", 0.5, "x"), ("a", "z", 0.25, "y"), ("c", "d", 0.2, "y"), ("d", "q", 0.1, "w")], "src string, dst string, confidence double, evidence string")
    got = {r["member"]: r["cluster_id"] for r in graph.clusters(e).collect()}
    assert got == {"a": "cluster:0", "z": "cluster:0", "b": "cluster:1", "c": "cluster:1", "d": "cluster:1"}
    facts = {r["cluster_id"]: r for r in graph.cluster_facts(graph.clusters(e), e).collect()}
    assert (facts["cluster:1"]["min_edge_confidence"], facts["cluster:1"]["weakest_evidence"], facts["cluster:1"]["n_addresses"]) == (0.2, "y", 3)


def test_snapshot_ignores_the_future(spark):
    rows = [("a", "b", "t1", 10, 0.3, "x"), ("b", "a", "t2", 20, 0.9, "y"), ("a", "c", "t3", 30, 0.5, "x")]
    ledger = spark.createDataFrame(rows, "src string, dst string, txid string, available_us long, confidence double, evidence string")
    assert [(r["src"], r["dst"], r["confidence"]) for r in graph.snapshot(ledger, 10).collect()] == [("a", "b", 0.3)]
    assert {(r["dst"], r["confidence"]) for r in graph.snapshot(ledger, 30).collect()} == {("b", 0.9), ("c", 0.5)}


def hop(txid, inp, pay, change, amount_pay=10, amount_change=90):
    return (txid, 1, [inp], [amount_pay + amount_change], [pay, change], [amount_pay, amount_change], False, False, 2, 1, amount_pay + amount_change)


TX = "txid string, first_seen_us long, input_addresses array<string>, input_amounts array<long>, output_addresses array<string>, output_amounts array<long>, is_coinbase boolean, has_equal_outputs boolean, n_out int, n_in int, total_in_sats long"


def run_chains(spark, rows, depth=1):
    return {r["root"]: (r["transactions"], r["stop_reason"]) for r in peel.chains(spark.createDataFrame(rows, TX), depth).collect()}


def test_chain_stops(spark):
    line = [hop("t1", "s", "p1", "c1"), hop("t2", "c1", "p2", "c2"), hop("t3", "c2", "p3", "c3")]
    assert run_chains(spark, line) == {"t1": (["t1", "t2", "t3"], "no_continuation")}
    twice = [*line, ("u1", 1, ["c3"], [1], ["q"], [1], False, False, 1, 1, 1), ("u2", 1, ["c3"], [1], ["q"], [1], False, False, 1, 1, 1)]
    assert run_chains(spark, twice)["t1"][1] == "ambiguous_spend"
    broken = [*line, ("u1", 1, ["c3"], [1], ["q"], [1], False, False, 1, 1, 1)]
    assert run_chains(spark, broken)["t1"][1] == "chain_broken"
    assert run_chains(spark, [hop("t1", "s", "p", "c", 36, 64)]) == {}  # more than 35 in 100
    assert len(run_chains(spark, [hop("t1", "s", "p", "c", 35, 65)])) == 1


def test_two_hops_into_one_and_cycles(spark):
    merge = [hop("t1", "a", "p", "m"), hop("t2", "b", "p", "n"), ("t3", 1, ["m", "n"], [90, 90], ["x", "y"], [20, 160], False, False, 2, 2, 180)]
    got = run_chains(spark, merge)
    assert got["t1"] == (["t1"], "chain_broken") and got["t2"] == (["t2"], "chain_broken") and "t3" in got
    ring = [hop("t2", "c1", "p", "c2"), hop("t3", "c2", "p", "c3"), hop("t1", "c3", "p", "c1"), hop("z1", "q", "p", "w"), hop("z2", "w", "p", "v")]
    assert run_chains(spark, ring) == {"t1": (["t1", "t2", "t3"], "cycle"), "z1": (["z1", "z2"], "no_continuation")}


def test_asof_directions(spark):
    left = spark.createDataFrame([("k", 10, 1), ("k", 20, 2), ("k", 5, 3), (None, 10, 4), ("j", 10, 5), ("k", None, 6)], "key string, t long, id int")
    right = spark.createDataFrame([("k", 10, "a"), ("k", 10, "b"), ("k", 15, "c"), (None, 1, "d"), ("k", None, "e")], "key string, r long, v string")
    run = lambda **m: {r["id"]: (r["r"], r["v"]) for r in asof.asof_join(left, right, ["key"], "t", "r", ["v"], **m).collect()}
    none = (None, None)
    assert run() == {1: (10, "b"), 2: (15, "c"), 3: none, 4: none, 5: none, 6: none}
    assert run(strict=True) == {1: none, 2: (15, "c"), 3: none, 4: none, 5: none, 6: none}
    assert run(direction="forward") == {1: (10, "a"), 2: none, 3: (10, "a"), 4: none, 5: none, 6: none}
    assert run(direction="forward", strict=True)[1] == (15, "c")


@pytest.mark.parametrize("seed", [1, 2])
def test_cidr_against_ipaddress(spark, seed):
    rng = random.Random(seed)
    blocks = [(str(ipaddress.ip_network((rng.randrange(2**8) << 24 | i << 16, 16 + rng.randrange(17)), strict=False)), f"b{i}") for i in range(12)]
    blocks += [("2001:db8::/33", "six"), ("2001:db8:8000::/36", "six2"), ("0.0.0.0/0x", "bad"), ("1.2.3.4", "bare"), ("::ffff/200", "wide"), ("", "empty"), (None, "null")]
    ips = [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(60)] + [str(ipaddress.ip_network(n)[rng.randrange(4) % ipaddress.ip_network(n).num_addresses]) for n, _ in blocks[:12]]
    ips += ["2001:db8::1", "2001:db8:8fff::", "2001:db8:9000::", "::", "1.2.3", "300.1.1.1", "x", "", "2001:DB8:0:1::5"]
    got = {r["ip"]: r["zone"] for r in asof.cidr_lookup(spark.createDataFrame([(i,) for i in dict.fromkeys(ips)], "ip string"), spark.createDataFrame(blocks, "network string, zone string"), "ip", "network", ["zone"]).collect()}
    for ip in dict.fromkeys(ips):
        want = None
        try:
            address = ipaddress.ip_address(ip)
            for n, zone in blocks[:14]:
                net = ipaddress.ip_network(n)
                if address.version == net.version and address in net:
                    want = zone
        except ValueError:
            pass
        assert got[ip] == want, ip


CAND = "txid string, peer_ip string, row_id long, delta_first_us long, payer_shared long, p_origin double, is_tor_exit boolean, n_observers_in_tx long, n_announcements long"


def test_finalise_rules(spark):
    rows = [
        ("tie", "a", 1, 0, 0, 0.3, False, 3, 5), ("tie", "b", 2, 0, 0, 0.3, False, 3, 5),
        ("over", "a", 3, 0, 0, 0.9, False, 3, 5), ("over", "b", 4, 0, 0, 0.3, False, 3, 5),
        ("tor", "a", 5, 0, 0, 0.4, True, 1, 1), ("one", "a", 6, 0, 0, 0.4, False, 1, 1), ("few", "a", 7, 0, 0, 0.4, False, 2, 1), ("alone", "a", 8, 0, 0, 0.4, False, 2, 9),
    ]
    got = {(r["txid"], r["peer_ip"]): r for r in finalise(spark.createDataFrame(rows, CAND), "x").collect()}
    reason = {k[0]: r["abstain_reason"] for k, r in got.items()}
    assert reason == {"tie": "margin_below_floor", "over": None, "tor": "tor_present", "one": "single_observer", "few": "too_few_announcements", "alone": None}
    assert [got["tie", p]["rank"] for p in "ab"] == [2, 3]  # nobody is first where we abstain
    assert got["over", "a"]["p_origin"] == pytest.approx(0.75) and got["over", "a"]["rank"] == 1  # capped at one
    assert got["alone", "a"]["margin"] == pytest.approx(0.4) and got["alone", "a"]["p_origin"] == pytest.approx(0.4)  # never raised to one


def test_orders_of_the_rules(spark):
    rows = [("t", "late", 1, 9, 5, 0.0, False, 3, 5), ("t", "early", 2, 0, 0, 0.0, False, 3, 5)]
    df = spark.createDataFrame(rows, CAND)
    lead = lambda x: x.orderBy(F.desc("p_origin")).first()["peer_ip"]
    assert lead(first_spy(df)) == "early"
    assert lead(fallback_ensemble(df)) == "late"
