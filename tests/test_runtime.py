import pytest
from pyspark.sql import functions as F

from peerlens import runtime


def test_hot_keys_and_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [(f"k{i}", i) for i in range(20)] + [(None, 1)] * 60, "key string, x int")
    right = spark.createDataFrame([("h", "H"), ("k1", "K"), ("z", "Z")], "key string, v string")
    assert runtime.hot_keys(left, "key", least=100) is None
    hot = runtime.hot_keys(left, "key", least=10)
    mark = spark.createDataFrame([("h",)], "key string").select(F.xxhash64("key")).first()[0]
    assert [tuple(r) for r in hot.collect()] == [(mark, 5)]  # null is no key
    for how, n in (("inner", 51), ("left", 130)):
        plain, skewed = (sorted(map(str, runtime.skew_join(left, right, "key", h, how).collect())) for h in (None, hot))
        assert plain == skewed and len(plain) == n
    # the rows of the hot key spread over its parts, equal rows too
    same = spark.createDataFrame([("h", 1)] * 400, "key string, x int").repartition(8)
    assert runtime.salted(same, ["key"], runtime.hot_keys(same, "key", least=100)).select("_salt").distinct().count() > 1
    assert runtime.hot_keys(left.limit(0), "key") is None


def test_durable_tables(spark):
    df = runtime.durable(spark.range(10).withColumn("x", F.lit("a")), "t")
    assert df.count() == 10 and df._peerlens_path.startswith(runtime.shared_dir(spark))
    runtime.discard(df, None)
    with pytest.raises(Exception):
        df.count()
    empty = runtime.durable(spark.createDataFrame([], "a long, b array<string>"), "e")
    assert empty.columns == ["a", "b"] and empty.isEmpty()


class _Session:
    """Just what the folder rule looks at."""

    def __init__(self, folder, master):
        self.conf = type("C", (), {"get": lambda self, key, default=None: folder})()
        self.sparkContext = type("S", (), {"master": master, "applicationId": "app-1"})()


def test_shared_folder_rule():
    assert runtime.shared_dir(_Session("hdfs://x/y/", "yarn")) == "hdfs://x/y/peerlens-app-1"
    assert runtime.shared_dir(_Session(None, "local[2]")).endswith("peerlens-app-1")
    with pytest.raises(ValueError):
        runtime.shared_dir(_Session(None, "yarn"))


def test_checkpoint_keeps_partitions(spark):
    df = runtime.checkpointed(spark.range(100, numPartitions=5).withColumn("p", F.spark_partition_id()))
    assert df.where(F.col("p") != F.spark_partition_id()).count() == 0


def test_small(spark):
    assert runtime.small(spark.range(5), 5).count() == runtime.small(spark.range(6), 5).count() - 1
