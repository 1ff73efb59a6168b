import gzip
import json

import pytest

from peerlens.operators import intake
from peerlens.sources import capture, sinks

TXID = "ab" * 32
CSV = f"""timestamp,src_ip,dst_ip,src_port,dst_port,TXN_HASH,input_addresses,input_amounts,output_addresses,output_amounts,asn,note
1735690000,198.18.0.1,192.0.2.1,8333,8333,{TXID},a|b,5|6,c,10,64500,x
,,,,,,,,,,,
1735690001,198.18.0.2,192.0.2.1,8333,8333,{TXID},,,c,10,,y
"""
ALIASES = {"txn_hash": "txid"}


def jsonl():
    rows = [
        {"timestamp": 1735690000, "src_ip": "198.18.0.1", "dst_ip": "192.0.2.1", "src_port": 8333, "dst_port": 8333, "txid": TXID, "input_addresses": ["a", "b"], "input_amounts": "5|6", "output_addresses": ["c"], "output_amounts": [10], "asn": 64500},
        {"timestamp": 1735690001, "src_ip": "198.18.0.2", "dst_ip": "192.0.2.1", "src_port": 8333, "dst_port": 8333, "txid": TXID, "input_addresses": [], "input_amounts": None, "output_addresses": ["c"], "output_amounts": [10], "asn": None},
    ]
    return "\n".join(map(json.dumps, rows))


def xml():
    def row(ts, ip, ins, amounts, asn):
        items = lambda xs: "".join(f"<item>{x}</item>" for x in xs)
        return f"<row><timestamp>{ts}</timestamp><src_ip>{ip}</src_ip><dst_ip>192.0.2.1</dst_ip><src_port>8333</src_port><dst_port>8333</dst_port><txid>{TXID}</txid><input_addresses>{items(ins)}</input_addresses><input_amounts>{items(amounts)}</input_amounts><output_addresses>{items('c')}</output_addresses><output_amounts>{items([10])}</output_amounts><asn>{asn}</asn></row>"

    return f"<rows>{row(1735690000, '198.18.0.1', 'ab', [5, 6], 64500)}{row(1735690001, '198.18.0.2', '', [], '')}</rows>"


def test_three_encodings_give_equal_rows(spark, tmp_path):
    import zstandard

    (tmp_path / "a.csv").write_bytes(CSV.encode("utf-8-sig"))
    (tmp_path / "b.txt").write_bytes(gzip.compress(jsonl().encode()))  # told by content, not by name
    (tmp_path / "c.xml.zst").write_bytes(zstandard.ZstdCompressor().compress(xml().encode()))
    (tmp_path / ".hidden.csv").write_text("x")
    (tmp_path / "_meta.json").write_text("{}")
    rows = capture.read_capture(spark, str(tmp_path), ALIASES)
    got = [r.asDict() for r in rows.orderBy("row_id").collect()]
    assert [r["row_id"] for r in got] == list(range(6))
    strip = lambda r: {k: v for k, v in r.items() if k not in ("row_id", "file_no", "line_no")}
    assert [strip(r) for r in got[0:2]] == [strip(r) for r in got[2:4]] == [strip(r) for r in got[4:6]]
    assert got[1]["input_addresses"] == [] and got[1]["asn"] is None and got[0]["input_amounts"] == ["5", "6"]
    typed = intake.coerce(rows, intake.detect_unit(rows), intake.detect_clock(rows)).collect()
    assert {r["reject_reason"] for r in typed} == {None}
    assert typed[0]["ts_us"] == 1735690000 * 10**6


@pytest.mark.parametrize(("data", "word"), [(b"\xff\xfe", "UTF-8"), (b"  ", "empty"), (b"[1]", "array"), (b"{]", "JSON"), (b"<!DOCTYPE x><r/>", "type")])
def test_file_level_failures(data, word):
    with pytest.raises(intake.IntakeError, match=word):
        text = capture.decode(data)
        list(capture.parse(text, capture.sniff(text), {}))


def test_units_and_clocks(spark):
    frame = lambda a, b: spark.createDataFrame([(a, b)], "input_amounts array<string>, output_amounts array<string>")
    assert intake.detect_unit(frame(["5"], ["1e8"])) == "sats"
    assert intake.detect_unit(frame(["0.5"], ["1.0"])) == "btc"
    assert intake.detect_unit(frame(["junk"], [])) == "sats"
    for bad in (frame(["5", "0.5"], []), frame(["5"], ["0.5"])):
        with pytest.raises(intake.IntakeError):
            intake.detect_unit(bad)
    clock = lambda *t: intake.detect_clock(spark.createDataFrame([(x,) for x in t], "timestamp string"))
    assert [clock("1735690000"), clock("1735690000000", "1"), clock("1735690000000000"), clock("1", "2025-01-01T00:00:00Z")] == ["s", "ms", "us", "iso"]


def test_breaker_and_status(spark):
    rows = lambda bad, n: spark.createDataFrame([("x",)] * bad + [(None,)] * (n - bad), "reject_reason string")
    intake.breaker(rows(1, 100))
    with pytest.raises(intake.IntakeError, match="x 2"):
        intake.breaker(rows(2, 100))
    assert intake.column_status(["a"], ("a",), ("fee_sats", "asn")) == {"a": "MAPPED", "fee_sats": "SYNTHESISED", "asn": "MISSING"}
    with pytest.raises(intake.IntakeError):
        intake.column_status([], ("a",), ())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", ["x", "y"]), (1, None, []), (1, None, [])], "id long, s string, input_addresses array<string>")
    digest = sinks.write_table(df, str(tmp_path / "t"), ["id"])
    assert digest == sinks.row_digest(df.repartition(3)) != sinks.row_digest(df.distinct())
    sinks.export_csv(df, str(tmp_path / "csv"))
    sinks.export_jsonl(df, str(tmp_path / "jsonl"))
    sinks.export_xml(df, str(tmp_path / "xml"))
    assert capture.read_large_csv(spark, str(tmp_path / "csv")).count() == 3
    assert capture.read_large_jsonl(spark, str(tmp_path / "jsonl")).count() == 3
    assert capture.read_large_xml(spark, str(tmp_path / "xml")).where("size(input_addresses) = 2").count() == 1
    assert sinks.differing_rows(df, df.limit(0).unionByName(df)).count() == 0
    with pytest.raises(ValueError):
        sinks.conform(df, {"missing": "int"})
    assert sinks.conform(df, {"s": "int", "id": "string"}).columns == ["s", "id"]
    meta = sinks.lineage(spark, str(tmp_path / "_meta.json"), "seal", {}, {}, {}, {"in": 3, "out": 2, "dropped": 1}, [])
    assert json.loads((tmp_path / "_meta.json").read_text()) == meta
    with pytest.raises(ValueError):
        sinks.lineage(spark, str(tmp_path / "x"), "seal", {}, {}, {}, {"in": 3, "out": 2, "dropped": 0}, [])


def test_lists(spark, tmp_path):
    (tmp_path / "tor.txt").write_text("# list\n198.18.0.1\nExitAddress 2001:db8::1 2025-01-01\nnothing\n")
    assert {r["ip"] for r in capture.address_list(spark, str(tmp_path / "tor.txt")).collect()} == {"198.18.0.1", "2001:db8::1"}
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "blocks.csv").write_text("network,asn\n198.18.0.0/24,64500\n")
    assert capture.vendor_blocks(spark, str(tmp_path)).count() == 1
