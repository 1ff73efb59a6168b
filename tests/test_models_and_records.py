import numpy as np
import pytest

from peerlens.operators import evidence
from peerlens.operators.models import contributions, digest, embeddings, score, train_and_score, train_trees, with_platt, with_risk


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x[:, 0] + 0.3 * rng.normal(size=400) > 0
    return spark.createDataFrame([(i, i * 10, float(a), float(b) if i % 9 else None, float(c), bool(k)) for i, ((a, b, c), k) in enumerate(zip(x, y))], "id long, t long, a double, b double, c double, y boolean")


def test_contributions_sum_to_the_margin(spark, data):
    model = train_trees(data, ["a", "b", "c"], "y", trees=5)
    x = np.nan_to_num(data.toPandas()[["a", "b", "c"]].to_numpy(dtype=float))
    bias, parts = contributions(model, x)
    assert len(model["trees"]) == 5
    got = score(data, model, "id", expected_digest=digest(model)).orderBy("id").toPandas()
    assert np.allclose(got["margin"], bias + parts.sum(axis=1), atol=1e-9)
    assert ((got["risk"] > 0.5) == data.orderBy("id").toPandas()["y"]).mean() > 0.85
    with pytest.raises(ValueError):
        score(data, model, "id", expected_digest="other")


def test_platt_line(spark, data):
    model = train_trees(data.where("id < 300"), ["a", "b", "c"], "y", trees=5)
    held = data.where("id >= 300")
    lined = with_platt(model, held, "y")
    frame = held.orderBy("id").toPandas()
    bias, parts = contributions(model, np.nan_to_num(frame[["a", "b", "c"]].to_numpy(dtype=float)))
    m, y = bias + parts.sum(axis=1), frame["y"].to_numpy(dtype=float)
    w = np.zeros(2)  # Newton steps on the same penalised likelihood
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w[0] * m + w[1])))
        g = np.array([((p - y) * m).sum() + w[0], (p - y).sum()])
        q = p * (1 - p)
        w -= np.linalg.solve(np.array([[(q * m * m).sum() + 1, (q * m).sum()], [(q * m).sum(), q.sum()]]), g)
    assert np.allclose(lined["platt"], w, atol=1e-3)
    got = with_risk(held, lined, "p").orderBy("id").toPandas()
    assert np.allclose(got["p"], 1 / (1 + np.exp(-(lined["platt"][0] * m + lined["platt"][1]))), atol=1e-9)
    assert np.allclose(score(held, lined, "id").orderBy("id").toPandas()["risk"], got["p"], atol=1e-9)
    assert digest(lined) != digest(model) and "platt" not in with_platt(model, held.limit(49), "y") and "platt" not in with_platt(model, held.where("y"), "y")


def test_sets(spark, data):
    out = train_and_score(data, ["a", "b", "c"], "y", "id", "t")
    assert out.count() == 400
    assert {r["label"] for r in out.select("label").distinct().collect()} <= {"UNCLEAR", "LIKELY_ILLICIT", "LIKELY_LICIT", "ABSTAIN"}


def test_embeddings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    design = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 1.0), ("c", 3.0, 0.0), ("lone", 4.0, 1.0)], "node_id string, x double, y double")
    got = embeddings(edges, design, dim=2)
    assert got.count() == 4 and got.columns == ["node_id", "e0", "e1"]


def test_signature_vector():
    # RFC 8032, 7.1, test 2
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    key = evidence.public_key(seed)
    assert key.hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    signature = evidence.sign(seed, b"\x72")
    assert signature.hex().startswith("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da")
    assert evidence.verify(key, b"\x72", signature)
    assert not evidence.verify(key, b"\x73", signature)
    assert not evidence.verify(key, b"\x72", b"\x00" * 64)


def test_log():
    log = evidence.Log()
    records = [{"a": i} for i in range(5)]
    heads = [log.append(r) for r in records]
    assert len(set(heads)) == 5 and log.verify(records)
    assert not log.verify(records[::-1])
    # ASCII only, so the bytes are the same wherever they are made
    assert evidence.canonical({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}'
    assert evidence.merkle_root([]) == "0" * 64
    for n in range(1, 20):
        log = evidence.Log()
        for i in range(n):
            head = log.append({"a": i})
        assert head == evidence.merkle_root(log.leaves)


def test_diverse(spark):
    rows = [("a", 0.9, ["1", "2"]), ("b", 0.8, ["1", "2"]), ("c", 0.7, ["3"]), ("d", None, ["4"]), ("e", 0.7, None)]
    assert evidence.diverse(spark.createDataFrame(rows, "id string, s double, tx array<string>"), "id", "s", "tx", 3) == ["a", "c"]  # no support, no lead
