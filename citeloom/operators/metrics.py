"""Aggregates over jobs, tokens, latencies and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import day_key


def token_budget(jobs: DataFrame, budget: int) -> DataFrame:
    """Jobs admitted while the day's tokens of the repository before them stay under the budget (0: no limit)."""
    day = day_key(F.col("ts"))
    before = Window.partitionBy("repo_id", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    used = jobs.withColumn("day", day).withColumn("used", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return used.withColumn("admitted", (F.lit(budget) <= 0) | (F.col("used") < budget))


def counts(rows: DataFrame, key: str, state: str, failed: str) -> DataFrame:
    """Rows of each key, how many states they are in, how many failed, and whether any did."""
    bad = F.col(state) == failed
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(state).alias("kinds"), F.count_if(bad).alias("failed"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("any_failed"))


def progress(chunks: DataFrame) -> DataFrame:
    """State of each repository's index run from its chunks' states."""
    done, failed = F.count_if(F.col("status") == "embedded"), F.count_if(F.col("status") == "failed")
    out = chunks.groupBy("repo_id").agg(F.count("*").alias("total"), done.alias("done"), failed.alias("failed"))
    state = F.when(F.col("pending") > 0, "indexing").when((F.col("total") > 0) & (F.col("failed") == F.col("total")), "error").otherwise("ready")
    return out.withColumn("pending", F.col("total") - F.col("done") - F.col("failed")).withColumn("state", state)


def latency(calls: DataFrame) -> DataFrame:
    """Per tool: 95th percentiles with and without embedding, and the cache's hit rate."""
    bare = F.greatest(F.col("latency_ms") - F.coalesce("embed_ms", F.lit(0.0)), F.lit(0.0))
    return calls.groupBy("tool").agg(
        F.count("*").alias("calls"),
        F.round(F.percentile("latency_ms", F.lit(0.95)), 6).alias("p95"),
        F.round(F.percentile(bare, F.lit(0.95)), 6).alias("p95_bare"),
        F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"),
    )


def breaker_trips(calls: DataFrame, threshold: int = 2) -> DataFrame:
    """Refusals (429) that complete a run of ``threshold`` without a success between; other failures do not count."""
    order = Window.partitionBy("provider").orderBy("ts", "id")
    runs = calls.filter(F.col("status").isin(200, 429)).withColumn("run", F.sum((F.col("status") == 200).cast("int")).over(order))
    in_run = Window.partitionBy("provider", "run").orderBy("ts", "id")
    refused = runs.filter("status = 429").withColumn("nth", F.row_number().over(in_run))
    return refused.filter(F.col("nth") >= threshold).select("provider", "id", "ts", "nth")


def evaluation(scores: DataFrame) -> DataFrame:
    """Rates and gates over scored queries (tool, passed, citation_ok, content_ok)."""
    share = lambda hit, tool: F.coalesce(F.count_if(hit & (F.col("tool") == tool)) / F.nullif(F.count_if(F.col("tool") == tool), F.lit(0)), F.lit(1.0))
    out = scores.agg(
        share(F.col("passed"), "search_codebase").alias("search_rate"),
        share(F.col("citation_ok"), "find_decision").alias("citation_rate"),
        F.count_if(F.col("content_ok") & (F.col("tool") == "find_decision")).alias("content_passed"),
        F.count_if(F.col("passed") & (F.col("tool") == "explain_file")).alias("explain_passed"),
    )
    return out.withColumn("passed", (F.col("search_rate") >= 0.8) & (F.col("citation_rate") >= 1.0))


def replay(cases: DataFrame) -> DataFrame:
    """Failures of hard and soft gates; fine without hard ones."""
    failed = ~F.col("passed")
    out = cases.agg(F.count_if(failed & (F.col("gate") == "hard")).alias("hard_failures"), F.count_if(failed & (F.col("gate") == "soft")).alias("soft_failures"))
    return out.withColumn("ok", F.col("hard_failures") == 0)


def endpoint_order(endpoints: DataFrame) -> DataFrame:
    """Enabled endpoints of each kind by priority."""
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("priority", "id"))
    return endpoints.filter("enabled").withColumn("nth", nth)
