import json

from peerlens.operators.drift import flood, schema_changes, select, unified_records

ALIASES = [("ctry", "geo_country"), ("from_ip", "src_ip"), ("sender_ip", "src_ip"), ("txn_hash", "txid"), ("vbytes", "vsize"), ("paid", "input_amounts"), ("asn_no", "asn")]


def frames(spark, files, records):
    f = spark.createDataFrame(files, "file_id long, feed string, file_no int, headers array<string>, kind string")
    r = spark.createDataFrame(records, "file_id long, row_no int, record string, kind string")
    return f, r, spark.createDataFrame(ALIASES, "alias string, column_name string")


def run(spark, files, records):
    return {tuple(r) for r in schema_changes(*frames(spark, files, records)).collect()}


def test_changes(spark):
    files = [
        (1, "f", 0, ["src_ip", "txid", "vsize", "blob", "﻿Ctry "], ""),
        (2, "f", 1, ["from_ip", "txid", "vbytes", "blob", "geo_country", "extra"], ""),
        (3, "f", 2, ["sender_ip", "from_ip", "TXID", "vbytes"], ""),
        (4, "f", 4, ["src_ip", "txid"], ""),  # 3 is missing: compared with 2
        (5, "g", 0, ["src_ip"], ""), (6, None, 0, ["a"], ""), (7, "h", 0, None, ""), (8, "h", 1, ["txid", None], ""),
    ]
    records = [
        (1, 0, json.dumps({"src_ip": "a", "txid": "t", "vsize": 5, "blob": True, "﻿Ctry ": "DE"}), ""),
        (2, 0, json.dumps({"from_ip": "a", "txid": ["t"], "vbytes": 5.5, "blob": None, "geo_country": "DE", "extra": 1}), ""),
        (3, 0, json.dumps({"from_ip": "a", "sender_ip": "b", "TXID": "t", "vbytes": 1.5}), ""),
        (3, 1, "no json", ""), (3, 2, None, ""), (4, 0, json.dumps({"src_ip": "a", "txid": "t"}), ""),
    ]
    assert run(spark, files, records) == {
        ("f", 1, "src_ip", "renamed"), ("f", 1, "txid", "retyped"), ("f", 1, "vsize", "renamed"), ("f", 1, "vsize", "retyped"), ("f", 1, "geo_country", "renamed"), ("f", 1, "extra", "added"),
        ("f", 2, "src_ip", "renamed"), ("f", 2, "from_ip", "added"), ("f", 2, "txid", "retyped"), ("f", 2, "blob", "removed"), ("f", 2, "geo_country", "removed"), ("f", 2, "extra", "removed"),
        ("f", 4, "src_ip", "renamed"), ("f", 4, "from_ip", "removed"), ("f", 4, "vsize", "removed"), ("h", 1, "txid", "added"),
    }


def test_empty(spark):
    assert run(spark, [], []) == set()


def test_flooding_prefers_the_dictionary_over_looks():
    field = lambda s, c, known, kind: {"spelling": s, "column_name": c, "known": known, "kind": kind}
    old = [field("asn", "asn", True, "whole"), field("asn_no2", "asn_no2", False, "whole")]
    new = [field("asn_no2", "asn_no2", False, "string"), field("zzz", "asn", True, "string")]
    assert sorted(select(flood(old, new))) == [(0, 1), (1, 0)]


def test_unified(spark):
    files = [(1, "f", 0, ["from_ip", "vbytes", "paid", "x"], ""), (2, "f", 1, ["src_ip", "vsize", "input_amounts"], "")]
    records = [(1, 0, json.dumps({"from_ip": "a", "vbytes": 12, "paid": [1, 2], "x": 1}), ""), (2, 0, json.dumps({"src_ip": "b", "vsize": "bad", "input_amounts": "3|4"}), ""), (2, 1, "junk", ""), (9, 0, "{}", "")]
    got = {r["file_no"]: r for r in unified_records(*frames(spark, files, records)).where("src_ip is not null").collect()}
    assert (got[0]["src_ip"], got[0]["vsize"], got[0]["input_amounts"], got[0]["other"]) == ("a", 12, ["1", "2"], {"x": "1"})
    assert (got[1]["src_ip"], got[1]["vsize"], got[1]["input_amounts"]) == ("b", None, ["3", "4"])


def test_a_header_twice(spark):
    files = [(1, "f", 0, ["fee", "fee", "Ctry", "ctry ", "x"], ""), (1, "f", 0, ["fee"], "")]
    records = [(1, 0, '{"fee": 1, "fee": 2, "Ctry": "DE", "ctry ": "FR", "x": 3, "late": 4}', "")]
    f, r, _ = frames(spark, files[:1], records)
    aliases = spark.createDataFrame([("fee", "fee_sats"), ("ctry", "geo_country")], "alias string, column_name string")
    row = unified_records(f, r, aliases).first()
    assert (row["fee_sats"], row["geo_country"]) == (1, "DE")
    assert row["other"] == {"fee": "2", "ctry": "FR", "x": "3", "late": "4"}


def test_nested_types_are_nodes():
    field = lambda s, inner: {"spelling": s, "column_name": s, "known": False, "kind": "array", "inner": inner}
    old, new = [field("a", ["STRING"]), field("b", ["BIGINT"])], [field("c", ["BIGINT"]), field("d", ["STRING"])]
    assert sorted(select(flood(old, new))) == [(0, 1), (1, 0)]


def test_numbers_with_gaps_only(spark, monkeypatch):
    from peerlens.operators import drift, ordered

    files = [(i, "f" if i % 3 else "g", (i * i) % 97 * 10, [f"h{i % 5}"], "") for i in range(40)]
    want = run(spark, files, [])
    monkeypatch.setattr(drift, "last_before", lambda *a, **k: ordered.last_before(*a, **k, hot_rows=4))
    assert len(want) > 20 and run(spark, files, []) == want
