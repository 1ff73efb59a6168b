from peerlens.streaming import first_seen

SCHEMA = "ts_us long, txid string, src_ip string, msg_type string"
T = 1_735_700_000_000_000


def feed(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    for part in rows:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return first_seen.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), late="1 second")


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_windows(spark, tmp_path):
    stream = feed(spark, tmp_path, [[(T + i, "t", f"p{i % 3}", "inv") for i in range(10)] + [(None, "t", "p", "inv")], [(T + 7_200_000_000, "u", "p", "inv")]])
    got = drain(spark, first_seen.announcement_windows(stream), "windows")
    assert [(r["n"], r["peers"]) for r in got] == [(10, 3)]


def test_sessions_and_repeats(spark, tmp_path):
    stream = feed(spark, tmp_path, [[(T, "t", "p", "inv"), (T, "t", "p", "inv"), (T + 1, "v", "p", "inv")], [(T + 7_200_000_000, "u", "q", "inv")]])
    got = drain(spark, first_seen.without_repeats(stream, ["txid", "src_ip"]), "repeats")
    assert len(got) == 3
    again = first_seen.with_event_time(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), late="1 second")
    assert {(r["src_ip"], r["n"]) for r in drain(spark, first_seen.peer_sessions(again), "sessions", "complete")} == {("p", 3), ("q", 1)}


def test_first_sights(spark, tmp_path):
    stream = feed(spark, tmp_path, [[(T + 5, "t", "b", "inv"), (T + 2, "t", "a", "inv"), (T + 6_000_000, "t", "c", "inv")], [(T + 60_000_000, "u", "x", "inv")], [(T + 120_000_000, "v", "y", "inv")]])
    got = {r["txid"]: (r["first_us"], r["src_ip"], r["n"]) for r in drain(spark, first_seen.first_sights(stream), "sights")}
    assert got["t"] == (T + 2, "a", 2)
