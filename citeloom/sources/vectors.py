"""A collection of encoded chunks on parquet, one partition a repository.

Rows are those of ``operators.index.encode`` with ``repo_id`` and the stamp of
the encoder; ``operators.index.pack`` makes an index of what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from citeloom.operators.index import ENCODER
from citeloom.session import keep


def checked(vectors: DataFrame) -> DataFrame:
    """Rows as they are; an empty vector stops the job."""
    return vectors.withColumn("vector", F.when(F.size("vector") > 0, F.col("vector")).otherwise(F.raise_error(F.lit("empty vector"))))


def mode(spark: SparkSession, path: str) -> str:
    """``missing``, ``hybrid``, or ``legacy`` where only dense vectors are stored."""
    try:
        columns = spark.read.parquet(path).columns
    except AnalysisException:
        return "missing"
    return "hybrid" if {"terms", "weights"} <= set(columns) else "legacy"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def delete_repository(spark: SparkSession, path: str, repo: str | int) -> None:
    """Drop the partition of a repository; others are not touched."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(repo))
    _remove(spark, f"{path}/repo_id={name}")


def prepare(spark: SparkSession, path: str, repo: str | int) -> str:
    """Make a collection ready for a full index of one repository, and say how.

    A missing one is ``created`` by the first write; of a hybrid one only this
    repository is ``cleared``; a legacy one is emptied as a whole (``recreated``).
    """
    if not str(repo).strip():
        raise ValueError("a repository needs a name")
    found = mode(spark, path)
    if found == "missing":
        return "created"
    if found == "hybrid":
        delete_repository(spark, path, repo)
        return "cleared"
    _remove(spark, path)
    return "recreated"


def replace_repositories(vectors: DataFrame, path: str, encoder: str = ENCODER) -> None:
    """Write the vectors of the repositories in ``vectors``; others stay as they are."""
    stamped = checked(vectors).withColumn("encoder", F.lit(encoder))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def upsert(vectors: DataFrame, path: str, encoder: str = ENCODER) -> None:
    """Write vectors; stored ones of the same repository and id give way, the rest of a repository stays."""
    spark = vectors.sparkSession
    fresh = keep(checked(vectors).withColumn("encoder", F.lit(encoder)))
    if mode(spark, path) == "hybrid":
        stored = spark.read.schema(fresh.schema).parquet(path)
        others = stored.join(fresh.select("repo_id").distinct(), "repo_id", "left_semi").join(fresh.select("repo_id", "id"), ["repo_id", "id"], "left_anti")
        fresh = keep(fresh.unionByName(others))  # what is read cannot be written over
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def delete_ids(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Take the vectors of ``ids`` out; only their repositories are written again."""
    stored = spark.read.parquet(path)
    touched = [r["repo_id"] for r in stored.join(ids.select("id"), "id", "left_semi").select("repo_id").distinct().collect()]  # names of repositories alone
    left = keep(without(stored.filter(F.col("repo_id").isin(touched)), ids))
    for repo in touched:
        delete_repository(spark, path, repo)
    left.write.mode("append").partitionBy("repo_id").parquet(path)


def without(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows but those of the ids."""
    return stored.join(ids.select("id"), "id", "left_anti")


def homogeneity(stored: DataFrame, encoder: str = ENCODER, sample: int = 64) -> DataFrame:
    """Missing and mismatched stamps in a sample of 1 to 256 rows."""
    rows = stored.limit(max(1, min(256, sample)))
    missing = F.coalesce("encoder", F.lit("")) == ""
    return rows.agg(F.count("*").alias("sampled"), F.count_if(missing).alias("missing"), F.count_if(~missing & (F.col("encoder") != encoder)).alias("mismatched"))
