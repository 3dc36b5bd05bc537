"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "citeloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder, by any path Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A session on one machine that names none gets a temporary folder, chosen once
    and kept in the session's settings; any other session must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("citeloom.scratch.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-citeloom-")
        spark.conf.set("citeloom.scratch.dir", found)
    return found


BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}  # what goes to Python at once while a step is written


def keep(frame: DataFrame, group: int | None = None) -> DataFrame:
    """``frame`` written to the shared folder and read back, so that it is computed once and lost executors cost nothing of it.

    Parquet reads up to 4,096 rows of a row group at once, and a row group is
    sized as compressed; where single rows are large, ``group`` is the most rows of one.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = frame.write if group is None else frame.write.option("parquet.block.row.count.limit", group)
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(frame.schema).parquet(path)
