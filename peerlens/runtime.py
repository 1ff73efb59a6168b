"""Session factory, table access and durable intermediate tables.

Iterative operators cut their lineage by writing a table to the shared folder
named by ``spark.checkpoint.dir``. That folder outlives any single executor, so
a lost executor costs a task retry and never the result.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side counted to hold at most this many rows may be broadcast by the operators.
BROADCAST_ROWS = 100_000


def session(app: str = "peerlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE on and the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_peerlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = tempfile.mkdtemp(prefix="peerlens-package-")
    archive = shutil.make_archive(os.path.join(root, "peerlens"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._peerlens_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the driver's parquet tables (a file or a folder of parts)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for durable intermediates, on storage every executor can reach.

    The session's ``spark.checkpoint.dir`` wins. A private temporary folder is
    used only where the setting is absent and the master is local, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = os.path.join(tempfile.gettempdir(), "peerlens-shared")
    return f"{base.rstrip('/')}/peerlens-{spark.sparkContext.applicationId}"


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage beyond the files and reports its true size to the
    planner, so later joins choose their strategy from facts.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._peerlens_path = path  # type: ignore[attr-defined]
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: as :func:`durable`, but partitions and order stay."""
    ship(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame | None) -> None:
    """Delete durable tables that no live result depends on."""
    for df in frames:
        path = getattr(df, "_peerlens_path", None)
        if not path:
            continue
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(spark: SparkSession) -> None:
    """Delete every durable table of this application."""
    path = shared_dir(spark)
    if "://" in path and not path.startswith("file:"):
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    else:
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small, else unchanged.

    Meant for durable or otherwise cheap frames: the count stops at the limit.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_keys(df: DataFrame, keys: str | list[str], least: int = 100_000, most: int = 20_000) -> DataFrame | None:
    """(_mark, _salts) of the keys that hold more than ``max(least, rows / most)`` rows.

    A key with a null part is none, as no join meets it. A key is marked by its hash, so the frame has fewer than ``most`` rows of 12
    bytes, however long the keys are; a key that shares its hash with a hot one is
    split like it, which changes no result. ``_salts`` is the number of parts of
    that size. None if there is no such key.
    """
    keys = [keys] if isinstance(keys, str) else keys
    counts = df.dropna("any", subset=keys).select(F.xxhash64(*keys).alias("_mark")).groupBy("_mark").agg(F.count(F.lit(1)).alias("_n"))
    # one pass usually shows that no key comes near the threshold
    total, top = counts.agg(F.sum("_n"), F.max("_n")).first()
    bound = max(least, (total or 0) // most)
    if not top or top <= bound:
        return None
    rows = [(r["_mark"], -(-r["_n"] // bound)) for r in counts.where(F.col("_n") > bound).collect()]
    return df.sparkSession.createDataFrame(rows, "_mark long, _salts int")


def salts(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``df`` with ``_salts``: the number of parts of each row's key, null for one."""
    return df.withColumn("_mark", F.xxhash64(*keys)).join(F.broadcast(hot), "_mark", "left").drop("_mark")


def salted(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``df`` with ``_salt``: the part of its key that a row belongs to.

    A function of the row and its partition, so a task that runs again gives the
    same parts, and equal rows of one key still spread.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    part = F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.col("_salts").cast("long")).cast("int")
    return salts(df, keys, hot).withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(part)).drop("_salts")


def repeated(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``df`` with each row once per part of its key, numbered by ``_salt``."""
    return salts(df, keys, hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def skew_join(left: DataFrame, right: DataFrame, keys: str | list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join on ``keys`` (``inner`` or ``left``) in which the hot keys of ``left`` are split.

    The rows of a hot key spread over its parts and meet a copy of the matching
    rows of ``right`` in each. Both sides are read once, so chains of such joins
    grow no faster than chains of plain ones.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if hot is None:
        return left.join(right, keys, how)
    return salted(left, keys, hot).join(repeated(right, keys, hot), [*keys, "_salt"], how).drop("_salt")
