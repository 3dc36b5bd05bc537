"""Relations derived from the given tables, for Spark and for the oracle alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its oracle where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".md", ".rst", ".dat")]), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), path.alias("file_path"), F.col("text").alias("content"))


FILES = """files AS (SELECT doc_id AS id, source || '/' || lang || '/' || doc_id::VARCHAR ||
  CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.rst' ELSE '.dat' END AS file_path, text AS content FROM documents)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decision records of their customer's repository."""
    o = table(spark, sf_dir, "orders")
    body = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    options = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("keep as is"))).otherwise(F.array().cast("array<string>"))
    reason = F.element_at(F.array(F.lit("chose speed over size"), F.lit("simple change"), F.lit("rather than waiting"), F.lit("plain")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo_id"), F.concat(F.lit("order "), F.col("o_orderpriority")).alias("topic"),
        F.concat(body, F.lit(": "), reason).alias("summary"), options.alias("alternatives"), F.col("o_orderdate").alias("decided_at"),
        F.when(F.col("o_orderkey") % 10 == 0, "doc").otherwise("pr").alias("source_type"),
        F.concat(F.when(F.col("o_orderkey") % 7 == 0, "local://x/").otherwise("https://example.org/o/"), F.col("o_orderkey").cast("string")).alias("source_url"),
        (F.col("o_totalprice") % 100 / 100).alias("confidence"),
        F.array(
            F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string"), F.lit("/en/"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 4 == 0, ".txt").otherwise(".md")),
            F.concat(F.lit("src"), (F.col("o_orderkey") % 20).cast("string"), F.lit("/none")),
        ).alias("touched_paths"),
    )


DECISIONS = """decisions AS (SELECT o_orderkey AS id, o_custkey AS repo_id, 'order ' || o_orderpriority AS topic,
  concat_ws(' ', o_orderpriority, o_orderstatus) || ': ' || ['chose speed over size', 'simple change', 'rather than waiting', 'plain'][o_orderkey % 4 + 1] AS summary,
  CASE WHEN o_orderkey % 3 = 0 THEN ['keep as is'] ELSE []::VARCHAR[] END AS alternatives, o_orderdate AS decided_at,
  CASE WHEN o_orderkey % 10 = 0 THEN 'doc' ELSE 'pr' END AS source_type,
  CASE WHEN o_orderkey % 7 = 0 THEN 'local://x/' ELSE 'https://example.org/o/' END || o_orderkey::VARCHAR AS source_url,
  o_totalprice % 100 / 100 AS confidence,
  ['src' || (o_custkey % 20)::VARCHAR || '/en/' || o_custkey::VARCHAR || CASE WHEN o_custkey % 4 = 0 THEN '.txt' ELSE '.md' END,
   'src' || (o_orderkey % 20)::VARCHAR || '/none'] AS touched_paths FROM orders)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EVENTS = "ev AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as history: clicks are merge requests, the rest commits; parts lend the wording of titles."""
    e = events(spark, sf_dir)
    title = F.element_at(
        F.array(*[F.lit(t) for t in TITLES]), (F.col("event_id") % len(TITLES) + 1).cast("int")
    )
    body = F.when(F.col("event_id") % 11 == 0, "done because of size").otherwise("")
    sha = F.concat(F.lit("s"), (F.col("event_id") % 5000).cast("string"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("repo_id"), F.when(F.col("event_type") == "click", "pr").otherwise("commit").alias("source_type"),
        title.alias("title"), body.alias("body"), F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("https://example.org/"), F.col("event_id").cast("string"))).alias("source_url"),
        sha.alias("source_sha"), F.array(F.concat(F.lit("s"), ((F.col("event_id") + 1) % 5000).cast("string"))).alias("commit_shas"), "ts", "k", "value",
    )


TITLES = (
    "chore: tidy", "Add index", "bump left-pad from 1 to 2", "Merge branch main", "docs: typo", "Switch to hashing", "v1.2.3", "wip", "Use sort merge", "fix: lint errors",
    "apply prettier", "release: v1.2", "Partition by key", "Update yarn.lock", "renovate: deps", "format", "Merge nothing", "feat: chose ORC over CSV",
)
SOURCES = EVENTS + """, sources AS (SELECT event_id AS id, user_id AS repo_id, CASE WHEN event_type = 'click' THEN 'pr' ELSE 'commit' END AS source_type,
  [%s][event_id %% %d + 1] AS title, CASE WHEN event_id %% 11 = 0 THEN 'done because of size' ELSE '' END AS body,
  CASE WHEN event_id %% 13 <> 0 THEN 'https://example.org/' || event_id::VARCHAR END AS source_url, 's' || (event_id %% 5000)::VARCHAR AS source_sha,
  ['s' || ((event_id + 1) %% 5000)::VARCHAR] AS commit_shas, ts, k, value FROM ev)""" % (", ".join(f"'{t}'" for t in TITLES), len(TITLES))
