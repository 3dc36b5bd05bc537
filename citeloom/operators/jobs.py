"""Records of jobs, repositories and runs: what is due, done, dropped or kept.

Windows here rank within a repository, provider or key and are cut to a few
rows, so that Spark cuts each partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.config import SETTINGS
from citeloom.functions import policy, text
from citeloom.operators import chunking

CACHE_TTL_MS = 600_000
CACHE_BYTES = 256 * 1024
PUSH_TTL_MS = 7 * 86_400_000


def newest(rows: DataFrame, time: str, limit: int, keys: tuple[str, ...] = ("repo_id",), then: tuple[str, ...] = ("id",)) -> DataFrame:
    """The newest ``limit`` rows of each key, numbered from 1 (``nth``)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), *then))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= limit)


def with_sources(decisions: DataFrame, sources: DataFrame, limit: int = 200) -> DataFrame:
    """The newest decisions of each repository with the sources of the same link, at most ``limit`` rows.

    A decision gives one row at least, so its repository's first ``limit`` are enough to join.
    """
    first = newest(decisions, "decided_at", limit).drop("nth")
    found = first.join(sources.select("source_url", F.col("id").alias("source_id"), "title", "body"), "source_url", "left")
    return newest(found, "decided_at", limit, then=("id", "source_id"))


def empty_share(decisions: DataFrame, limit: int = 100) -> DataFrame:
    """How many of each repository's newest decisions name no alternative: (repo_id, empty, shown)."""
    return newest(decisions, "decided_at", limit).groupBy("repo_id").agg(F.count_if(F.size("alternatives") == 0).alias("empty"), F.count("*").alias("shown"))


def failed_jobs(jobs: DataFrame, job_type: str = "extract_decisions", limit: int = 50) -> DataFrame:
    """The newest failures of a kind of job in each repository."""
    return newest(jobs.filter((F.col("job_type") == job_type) & (F.col("status") == "error")), "created_at", limit)


def not_done(wanted: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted jobs whose key has not ended as done before."""
    return wanted.join(history.filter("status = 'done'").select(*keys), keys, "left_anti")


def register(repositories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted repositories (name, branch) with their stored identifier, or a new one made from the name.

    A named branch replaces the stored one; ``main`` stands where neither is known.
    """
    once = wanted.groupBy("name").agg(F.max("branch").alias("branch"))
    stored = repositories.select("name", "repo_id", F.col("branch").alias("old_branch"))
    joined = once.join(stored, "name", "left")
    return joined.select(
        "name", F.coalesce("repo_id", F.sha2("name", 256)).alias("repo_id"), F.coalesce("branch", "old_branch", F.lit("main")).alias("branch"), F.col("repo_id").isNull().alias("created")
    )


def cleared(rows: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rows but those of the repositories to clear."""
    return rows.join(repositories.select("repo_id"), "repo_id", "left_anti")


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with the end told by ``results`` (id, status, latency_ms, tokens, message); a message stays only with an error."""
    told = results.select("id", F.col("status").alias("__status"), F.col("latency_ms").alias("__ms"), F.col("tokens").alias("__tokens"), F.col("message").alias("__message"))
    joined, ended = jobs.join(told, "id", "left"), F.col("__status").isNotNull()
    return joined.withColumns({
        "status": F.coalesce("__status", "status"),
        "latency_ms": F.when(ended, F.col("__ms")).otherwise(F.col("latency_ms")),
        "tokens": F.when(ended, F.coalesce("__tokens", F.lit(0))).otherwise(F.col("tokens")),
        "message": F.when(ended, F.when(F.col("__status") == "error", F.col("__message"))).otherwise(F.col("message")),
    }).drop("__status", "__ms", "__tokens", "__message")


def pending(chunks: DataFrame) -> DataFrame:
    """Chunks that are not embedded yet."""
    return chunks.filter(F.coalesce(F.col("status") != "embedded", F.lit(True)))


def merged_requests(pulls: DataFrame, after: Column) -> DataFrame:
    """Merge requests that were merged, as sources: their commit and all commits they bring.

    Expects merged_at, merge_sha, head_sha, commit_shas and a column that tells the pushed commit.
    """
    sha = F.coalesce("merge_sha", "head_sha", after)
    shas = F.array_distinct(F.array_append(F.coalesce("commit_shas", F.array().cast("array<string>")), sha))
    return pulls.filter("merged_at is not null").withColumn("source_sha", sha).withColumn("commit_shas", F.filter(shas, lambda s: s.isNotNull()))


def queued(judged: DataFrame, limit: int | None = None) -> DataFrame:
    """Selected sources of each repository in order, merge requests first, at most ``limit`` (none or 0: all)."""
    order = Window.partitionBy("repo_id").orderBy(F.when(F.col("source_type") == "pr", 0).otherwise(1), "id")
    placed = judged.filter("outcome = 'selected'").withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= limit) if limit and limit > 0 else placed


def flush_plan(ranges: DataFrame, history: DataFrame, active: DataFrame, now_ms: int, ttl_ms: int = PUSH_TTL_MS) -> DataFrame:
    """What becomes of each deferred range (repo_id, before, after, updated_ms) once its index is ready.

    ``expired`` after its time to live, ``done`` if its tip was processed,
    ``active`` if it runs, else ``flush``: one job from ``before`` to ``after``.
    """
    done = history.filter("status = 'done'").select("repo_id", "after").distinct().withColumn("__done", F.lit(True))
    runs = active.select("repo_id", "after").distinct().withColumn("__runs", F.lit(True))
    joined = ranges.join(done, ["repo_id", "after"], "left").join(runs, ["repo_id", "after"], "left")
    action = F.when(F.col("updated_ms") + ttl_ms <= now_ms, "expired").when(F.col("__done"), "done").when(F.col("__runs"), "active").otherwise("flush")
    return joined.withColumn("action", action).drop("__done", "__runs")


def breaker_states(calls: DataFrame, threshold: int = 2, cooldown_ms: int = 300_000) -> DataFrame:
    """The breaker's state before each call (provider, id, at_ms, status): closed, open or half-open.

    Each refusal (429) that makes ``threshold`` or more since a success opens
    it for the cooldown; then one call may probe: a success closes it, another
    refusal opens it again. Other failures change nothing.
    """
    order = Window.partitionBy("provider").orderBy("at_ms", "id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    refused = F.col("status") == 429
    runs = calls.withColumn("__run", F.sum((F.col("status") == 200).cast("int")).over(order))
    nth = F.sum(refused.cast("int")).over(Window.partitionBy("provider", "__run").orderBy("at_ms", "id"))
    runs = runs.withColumn("__nth", nth)
    told = F.when(F.col("status") == 200, F.lit(-1)).when(refused, F.when(F.col("__nth") >= threshold, F.col("at_ms") + cooldown_ms).otherwise(-1))
    until = F.coalesce(F.last(told, ignorenulls=True).over(before), F.lit(-1))
    state = F.when(until < 0, "closed").when(F.col("at_ms") < until, "open").otherwise("half-open")
    return runs.withColumn("state", state).drop("__run", "__nth")


def cache_log(calls: DataFrame, ttl_ms: int = CACHE_TTL_MS, most: int = CACHE_BYTES) -> DataFrame:
    """Whether each read finds its key (calls: key, id, at_ms, kind ``get`` or ``set``, bytes).

    The key holds the index epoch, so a new epoch misses. Values over ``most``
    bytes are never stored; the last stored one lives for ``ttl_ms``.
    """
    before = Window.partitionBy("key").orderBy("at_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    stored = F.last(F.when((F.col("kind") == "set") & (F.col("bytes") <= most), F.col("at_ms")), ignorenulls=True).over(before)
    return calls.withColumn("hit", F.coalesce(F.col("at_ms") < stored + ttl_ms, F.lit(False))).filter("kind = 'get'")


def may_read(kind: Column, own: Column, asked: Column) -> Column:
    """Whether a principal may read a repository: a token of one repository only that one, others all."""
    return F.when(kind == "repo", F.coalesce(own == asked, F.lit(False))).otherwise(kind.isin("admin", "open"))


def chunk_outcomes(attempts: DataFrame, most: int = 3) -> DataFrame:
    """State of each chunk from its attempts (chunk, ok): embedded, failed after ``most`` failures, or due again."""
    out = attempts.groupBy("chunk").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    return out.withColumn("state", F.when(F.col("good") > 0, "embedded").when(F.col("bad") >= most, "failed").otherwise("due"))


def doc_files(files: DataFrame, repositories: DataFrame, max_bytes: int = SETTINGS.max_doc_bytes) -> DataFrame:
    """Decision-shaped documents with their ``outcome`` in a run: no base, secret, oversize or considered.

    Expects repo_id, id, file_path, content; ``repositories`` has repo_id and https_base.
    """
    shaped = files.filter(text.is_decision_doc(F.col("file_path"))).join(repositories.select("repo_id", "https_base"), "repo_id", "left")
    outcome = (
        F.when(F.coalesce("https_base", F.lit("")) == "", "no base").when(policy.is_secret_path(F.col("file_path")), "secret")
        .when(F.octet_length("content") > max_bytes, "oversize").when(policy.must_refuse(F.col("file_path"), F.col("content")), "secret").otherwise("considered")
    )
    return shaped.withColumn("outcome", outcome)


def doc_run(files: DataFrame, repositories: DataFrame, budget: int = SETTINGS.doc_decisions_per_run, max_bytes: int = SETTINGS.max_doc_bytes) -> DataFrame:
    """Drafts that a run stores: each repository's first ``budget`` in order of file and section.

    That is what a budget counted down file by file leaves, the file that
    crosses it cut and the run ended there.
    """
    considered = doc_files(files, repositories, max_bytes).filter("outcome = 'considered'")
    drafts = chunking.doc_sections(considered).join(considered.select("id", "repo_id", "https_base"), "id")
    return within_budget(drafts, "repo_id", ("file_path", "id", "start_line"), budget)


def within_budget(rows: DataFrame, run: str, order: tuple[str, ...], budget: int) -> DataFrame:
    """The first ``budget`` rows of each run, numbered from 1 (``nth``)."""
    nth = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= budget)


def replaced_by_run(decisions: DataFrame, run: DataFrame) -> DataFrame:
    """Stored decisions of documents that touch a path of the run, to be deleted before it is stored."""
    touched = decisions.filter("source_type = 'doc'").select("repo_id", "id", F.explode("touched_paths").alias("file_path"))
    hit = touched.join(run.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi").select("repo_id", "id").distinct()
    return decisions.join(hit, ["repo_id", "id"], "left_semi")
