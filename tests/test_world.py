import pytest

from peerlens.operators import asof, evaluate, world


@pytest.fixture(scope="module")
def made():
    return world.build(world.configure())


def test_value_is_conserved_and_nothing_spent_twice(made):
    spent, created, born = set(), {}, dict(zip(made["origins"]["txid"], made["origins"]["broadcast_us"], strict=True))
    for r in made["transactions"].itertuples():
        for k in zip(r.input_txids, r.input_vouts, strict=True):
            assert k not in spent
            spent.add(k)
            if k[0] in born:
                assert born[k[0]] < born[r.txid]  # parents first
                assert created[k] in zip(r.input_addresses, r.input_amounts, strict=True)
        for v, out in enumerate(zip(r.output_addresses, r.output_amounts, strict=True)):
            created[(r.txid, v)] = out
        assert min(r.output_amounts) > 0
        assert r.is_coinbase or sum(r.input_amounts) == sum(r.output_amounts) + r.fee_sats
    assert made["transactions"]["txid"].is_unique and len(made["transactions"]) > 200


def test_population_and_campaigns(made):
    e = made["entities"]
    assert len(e) == 80 and e["is_illicit"].sum() == 12
    assert world.shares({"a": 0.5, "b": 0.25, "c": 0.25}, 7) == {"a": 3, "b": 2, "c": 2}
    known = set(made["transactions"]["txid"])
    for c in made["campaigns"].itertuples():
        assert set(c.txids) <= known and c.start_us <= c.end_us and c.typology in (*world.PATTERNS, "none")
        assert set(c.entity_ids) <= set(e[e["is_illicit"]]["entity_id"])
    assert world.build(world.configure())["transactions"].equals(made["transactions"])


def test_configuration():
    assert world.configure(overrides=("world.blocks=3",))["world"]["blocks"] == 3
    assert world.configure({"money": {"fee_mu": 1}}, regime="quiet")["campaigns"]["count"] == 0
    for bad in (("world.blocs=3",), ("nothing=1",)):
        with pytest.raises(KeyError):
            world.configure(overrides=bad)
    with pytest.raises(TypeError):
        world.configure({"world": {"blocks": "x"}})
    assert world.DEFAULTS["world"]["blocks"] == 60


def test_tables_and_vendor_lists(spark, tmp_path):
    cfg = world.configure(overrides=("world.blocks=5",))
    path = str(tmp_path / "w")
    world.write_world(spark, cfg, path)
    assert spark.read.parquet(f"{path}/truth/origins").columns == world.ORIGIN
    with pytest.raises(Exception):
        world.write_world(spark, cfg, path)
    ips = spark.createDataFrame([("198.18.1.9",), ("100.64.3.4",), ("2001:db8:2::7",), ("8.8.8.8",)], "ip string")
    got = {r["ip"]: r["country"] for r in asof.cidr_lookup(ips, world.vendor_lists(spark, cfg), "ip", "network", ["country"]).collect()}
    assert got == {"198.18.1.9": "BR", "100.64.3.4": "DE", "2001:db8:2::7": "IN", "8.8.8.8": None}


def test_label_door_and_wallet_report(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "k string, first_us long")
    truth = spark.createDataFrame([("a", "x"), ("b", "y"), ("z", "w")], "k string, label string")
    got = {r["k"]: r["is_training"] for r in evaluate.label_door(truth, seen, "k", "first_us", 5).collect()}
    assert got == {"a": True, "b": False}
    predicted = spark.createDataFrame([("s1", "a1", 0.9, False, True), ("s1", "a2", 0.9, False, True), ("s2", "a3", 0.1, True, False), ("s3", "a4", 0.8, True, True)], "subject_id string, address string, risk double, in_set_0 boolean, in_set_1 boolean")
    owners = spark.createDataFrame([("a1", "e1", True, 10), ("a2", "e2", False, 10), ("a3", "e2", False, 10), ("a4", "e3", True, 10), ("a9", "e4", True, 10), ("a1x", "e1", True, 1)], "address string, entity_id string, is_illicit boolean, first_us long")
    r = evaluate.wallet_report(predicted, owners, 5, k=2).first().asDict()
    # a tie (s1) is licit; s1 and s3 are flagged
    assert (r["n_subjects"], r["n_illicit"], r["precision_at_k"], r["recall_at_k"]) == (3, 1, 0.5, 1.0)
    assert (r["campaigns"], r["caught"]) == (3, 2)
    assert (r["coverage_licit"], r["coverage_illicit"]) == (0.5, 1.0)
