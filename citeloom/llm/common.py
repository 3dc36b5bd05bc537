"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
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


# While a step is written: its shuffle files are let go when it ends, and rows go to Python in batches of so many bytes.
HELD = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def materialize(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage and survives lost executors: the files are in shared
    storage. Later reads prune columns, which a row checkpoint cannot. Shuffle
    files of the job that wrote them are let go when it ends. ``discard`` deletes
    the files once no frame needs them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = {k: spark.conf.get(k, None) for k in HELD}
    for k, v in HELD.items():
        spark.conf.set(k, v)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for frame in frames:
        spark, path = frame.sparkSession, frame.written_to
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_KEPT: dict[int, tuple[int, dict]] = {}  # caches of this worker, each with the stage that fills it


def _stage() -> int:
    here = TaskContext.get()
    return -1 if here is None else here.stageId()


def keep_for_stage(cache: dict) -> None:
    """Let later tasks of this stage find ``cache`` as it is; the first one of another stage that reads slices empties it."""
    _KEPT[id(cache)] = _stage(), cache


def _let_go() -> None:
    over = [k for k, (stage, _) in _KEPT.items() if stage != _stage()]
    for k in over:
        _KEPT.pop(k)[1].clear()
    if over:
        pa.default_memory_pool().release_unused()


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``max_bytes`` of ``column``.

    A single longer value stands alone in its slice: no value is ever cut.
    """
    _let_go()
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows or values.nbytes <= max_bytes:
            if batch.num_rows:
                yield batch
            continue
        lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def column_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [b"" if x is None else x for x in values.cast(pa.binary()).to_pylist()]


def column_texts(batch: pa.RecordBatch, column: str) -> list[str]:
    values = batch.column(batch.schema.get_field_index(column))
    return ["" if x is None else x for x in values.to_pylist()]
