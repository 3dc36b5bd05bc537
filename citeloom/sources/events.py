"""Push events and history records: parsing, signatures and routing."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.config import SETTINGS
from citeloom.functions import ignore, policy
from citeloom.sources import files

PUSH = "struct<ref:string,before:string,after:string,repository:struct<full_name:string>>"
ZERO = "0" * 40


def parse_push(payload: Column) -> Column:
    """(ref, before, after, full_name) of a branch push; null for other payloads and deletions."""
    p = F.from_json(payload, PUSH)
    usable = F.startswith(p["ref"], F.lit("refs/heads/")) & p["before"].isNotNull() & (p["after"] != ZERO) & p["repository"]["full_name"].isNotNull()
    return F.when(usable, F.struct(p["ref"].alias("ref"), p["before"].alias("before"), p["after"].alias("after"), p["repository"]["full_name"].alias("full_name")))


def verify_signature(secret: str):
    """Column function: whether ``sha256=<hex>`` signs a body, compared in constant time."""

    def each(body: pd.Series, header: pd.Series) -> pd.Series:
        def one(b, h):
            if b is None or not isinstance(h, str) or not h.startswith("sha256="):
                return False
            return hmac.compare_digest("sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest(), h)

        return pd.Series([one(b, h) for b, h in zip(body, header)], dtype=bool)

    each.__annotations__ = {"body": pd.Series, "header": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "boolean")


def route(requests: DataFrame) -> DataFrame:
    """Status of each request (event, payload, has_secret, signed, known, duplicate), by the first rule that holds."""
    readable = F.from_json("payload", "map<string,string>").isNotNull()
    status = (
        F.when(~F.col("has_secret"), 503).when(~F.col("signed"), 401).when(F.col("event") == "ping", 200).when(F.col("event") != "push", 200)
        .when(~readable, 400).when(parse_push(F.col("payload")).isNull(), 200).when(~F.col("known"), 404).when(F.col("duplicate"), 200).otherwise(202)
    )
    return requests.withColumn("status", status)


def parse_log(text: Column) -> Column:
    """Records (sha, at, subject, body) of a NUL-delimited log; those without a whole hash are left out."""
    fields = F.split(text, "\0")
    starts = F.sequence(F.lit(0), F.greatest(F.floor(F.size(fields) / 4).cast("int") - 1, F.lit(0)))
    get = lambda i, k: F.trim(F.coalesce(F.get(fields, i * 4 + k), F.lit("")))
    made = F.transform(starts, lambda i: F.struct(get(i, 0).alias("sha"), get(i, 1).alias("at"), get(i, 2).alias("subject"), get(i, 3).alias("body")))
    return F.filter(made, lambda r: r["sha"].rlike("^[0-9a-f]{40}$"))


def list_files(spark: SparkSession, root: str, extra: tuple[str, ...] = (), most_bytes: int = SETTINGS.max_file_bytes) -> DataFrame:
    """Text files under ``root`` (file_path, content), sorted by path, that are not excluded, too large or binary.

    Every ignore file under ``root`` counts for its own folder, the deeper one
    after the one above it, and all after the fixed patterns, as in a walk.
    """
    files.register(spark)
    listed = spark.read.format("repository_files").option("maxBytes", most_bytes).load(root)
    named = listed.filter(F.element_at(F.split("file_path", "/"), -1) == ".gitignore").select("file_path", F.col("content").cast("string").alias("content"))
    lines = sorted(((r["file_path"], r["content"]) for r in named.toLocalIterator()), key=lambda x: (x[0].count("/"), x[0]))
    rules = [r for path, text in lines for r in ignore.rules(text, path.rpartition("/")[0])]
    kept = listed.filter(~policy.is_excluded(F.col("file_path"), [*ignore.rules(extra), *rules]))
    texts = kept.select("file_path", F.col("content").cast("string").alias("content"))
    return texts.filter(F.instr("content", "\0") == 0).orderBy("file_path")
