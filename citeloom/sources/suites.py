"""Suites of replay cases and golden queries as JSON, read with explicit schemas and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPLAY = (
    "version int, description string, cases array<struct<id:string,tool:string,query:string,gate:string,expect:struct<anyOfPathIncludes:array<string>,hitAt:int,expectEmpty:boolean,"
    "maxCount:int,topicOrSummaryIncludesAny:array<string>,requireCitationHttp:boolean>>>"
)
TOOLS = ("search_codebase", "find_decision")


def _fault(case: Column) -> Column:
    """Why a case is refused; null if it is not."""
    e = case["expect"]
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    search, within = case["tool"] == "search_codebase", lambda n: F.coalesce(n.between(1, 50), F.lit(True))
    return (
        F.when(F.coalesce(case["id"], F.lit("")) == "", "a case needs an id").when(F.coalesce(case["query"], F.lit("")) == "", "a case needs a query")
        .when(~F.coalesce(case["tool"].isin(*TOOLS), F.lit(False)), "unknown tool").when(~F.coalesce(case["gate"], F.lit("hard")).isin("hard", "soft"), "unknown gate")
        .when(~within(e["hitAt"]) | ~within(e["maxCount"]), "a bound is from 1 to 50")
        .when(search & ~F.coalesce(e["expectEmpty"], F.lit(False)) & ~some(e["anyOfPathIncludes"]), "anyOfPathIncludes is needed unless nothing is expected")
        .when(~search & ~some(e["topicOrSummaryIncludesAny"]), "topicOrSummaryIncludesAny is needed")
    )


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Cases of suites under ``path``, one a row, with defaults filled in; a suite that breaks the form stops the job."""
    suites = spark.read.schema(REPLAY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    stop = lambda why: F.raise_error(F.concat(F.lit("suite refused: "), why))
    sound = F.when(F.coalesce("version", F.lit(0)) != 1, stop(F.lit("version"))).when(F.coalesce(F.size("cases"), F.lit(0)) <= 0, stop(F.lit("no cases"))).otherwise(F.col("cases"))
    c = F.col("c")
    rows = suites.select("description", F.posexplode(sound).alias("nth", "c")).withColumn("c", F.when(_fault(c).isNotNull(), stop(_fault(c))).otherwise(c))
    e = F.col("c.expect")
    none = F.array().cast("array<string>")
    return rows.select(
        "description", "nth", "c.id", "c.tool", "c.query", F.coalesce("c.gate", F.lit("hard")).alias("gate"), F.coalesce(e["anyOfPathIncludes"], none).alias("paths"), F.coalesce(e["hitAt"], F.lit(3)).alias("hit_at"),
        F.coalesce(e["expectEmpty"], F.lit(False)).alias("expect_empty"), e["maxCount"].alias("max_count"), F.coalesce(e["topicOrSummaryIncludesAny"], none).alias("needles"),
        F.coalesce(e["requireCitationHttp"], F.lit(True)).alias("citation"),
    )


def searched(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Search cases with ``passed``, by hits (id of the case, position, file_path, symbol): one of the first is named so, or there is none."""
    at = hits.withColumnRenamed("id", "case")
    joined = cases.filter("tool = 'search_codebase'").join(at, F.col("id") == F.col("case"), "left")
    named = F.exists("paths", lambda p: F.contains(F.coalesce("file_path", F.lit("")), p) | F.contains(F.coalesce("symbol", F.lit("")), p))
    found = joined.groupBy("id", "tool", "gate", "expect_empty").agg(F.count("case").alias("n"), F.coalesce(F.bool_or((F.col("position") <= F.col("hit_at")) & named), F.lit(False)).alias("hit"))
    return found.select("id", "tool", "gate", F.when(F.col("expect_empty"), F.col("n") == 0).otherwise(F.col("hit")).alias("passed"))
