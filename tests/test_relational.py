import math

from peerlens.operators import features


def test_context_is_pooled_through_both_sides(spark):
    tx = spark.createDataFrame(
        [("t1", 10, ["a"], ["b"], 1, 1, 100, 5, 2.0, False), ("t2", 20, ["b", "c"], ["d"], 2, 1, 300, 7, 4.0, True), ("t3", None, ["a"], ["d"], 1, 1, 1, 1, 1.0, False)],
        "txid string, first_seen_us long, input_addresses array<string>, output_addresses array<string>, n_in int, n_out int, total_out_sats long, fee_sats long, fee_rate_sat_vb double, has_equal_outputs boolean",
    )
    members = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "address string, subject_id string")
    ann = spark.createDataFrame([("t2", "p1", "o1", 20), ("t2", "p1", "o2", 21), ("t2", "p2", "o1", 22), ("t1", "p2", "o1", 11)], "txid string, peer_ip string, observer_ip string, seen_us long")
    peers = spark.createDataFrame([("p1", "hosting"), ("p2", None)], "peer_ip string, net_class string")
    local = spark.createDataFrame([("A", 1.0), ("B", -3.0), ("C", None), ("D", 0.0)], "subject_id string, x double")
    got = features.relational(tx, members, ann, peers, local, {"hosting": 1})
    # own values, and per side the degree and four statistics of 6 + 9 + own context values
    assert len(got.columns) == 1 + 1 + 2 * (1 + 4 * (6 + 9 + 1))
    r = {x["subject_id"]: x.asDict() for x in got.collect()}
    assert set(r) == {"A", "B", "C", "D"}
    close = lambda a, b: math.isclose(a, b, abs_tol=1e-9)
    assert close(r["D"]["received_degree"], math.log(2)) and r["D"]["spent_degree"] == 0 and r["D"]["spent_fee_sats_max"] == 0  # only receives
    assert close(r["D"]["received_fee_sats_mean"], math.log1p(7)) and close(r["D"]["received_has_equal_outputs_mean"], math.log(2))
    assert close(r["D"]["received_announcer_mean_observations_mean"], math.log1p(2)) and close(r["D"]["received_announcer_mean_class_1_mean"], 0.5)
    assert close(r["D"]["received_funder_mean_x_mean"], -math.log1p(3) / 2)
    assert close(r["B"]["x"], -math.log1p(3)) and close(r["B"]["received_funder_mean_x_max"], math.log1p(1)) and close(r["B"]["spent_n_in_min"], math.log1p(2))


def test_query_has_all_columns(spark):
    import os

    import pytest

    import __spark_entry__ as contract

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables are absent")
    df = contract.queries()["ftr16_relational"](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    assert len(df.columns) == 1 + 329 and len(rows) == len({r["subject_id"] for r in rows}) > 0
    assert any(r["received_degree"] > 0 and r["spent_degree"] == 0 for r in rows)
    assert not any(v is None or v != v for r in rows for v in r)
