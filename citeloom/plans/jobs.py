"""Queries on job records, repositories, runs over documents, breakers and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import jobs, ranking, sync
from citeloom.plans.base import DECISIONS, EVENTS, SOURCES, SQL, decisions, events, query, sources
from citeloom.plans.history import _pushes
from citeloom.session import table


@query("sync_queue_sources", f"""SELECT id, repo_id, source_type, place FROM (SELECT id, repo_id, source_type, row_number() OVER (PARTITION BY repo_id ORDER BY (source_type = 'pr') DESC, id) AS place
 FROM ({SQL['sync_select_sources']}) WHERE outcome = 'selected') WHERE place <= 5""")
def queue_sources(spark, sf_dir):
    """Each repository's first five selected sources, merge requests before commits."""
    return jobs.queued(sync.select_sources(sources(spark, sf_dir)), 5).select("id", "repo_id", "source_type", "place")


@query(
    "join_newest_sources",
    f"""WITH {DECISIONS}, {SOURCES}, d AS (SELECT repo_id, id, decided_at, 'https://example.org/' || id::VARCHAR AS source_url FROM decisions),
j AS (SELECT d.repo_id, d.id, s.id AS source_id, title, row_number() OVER (PARTITION BY d.repo_id ORDER BY decided_at DESC, d.id, s.id) AS nth FROM d LEFT JOIN sources s USING (source_url)) SELECT * FROM j WHERE nth <= 8""",
)
def newest_sources(spark, sf_dir):
    """The newest decisions of every repository with their sources, those without one kept."""
    d = decisions(spark, sf_dir).withColumn("source_url", F.concat(F.lit("https://example.org/"), F.col("id").cast("string")))
    return jobs.with_sources(d.select("repo_id", "id", "decided_at", "source_url"), sources(spark, sf_dir), 8).select("repo_id", "id", "source_id", "title", "nth")


@query("agg_empty_alternatives", f"""WITH {DECISIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY decided_at DESC, id) AS nth FROM decisions)
SELECT repo_id, count(*) FILTER (len(alternatives) = 0) AS empty, count(*) AS shown FROM n WHERE nth <= 6 GROUP BY repo_id""")
def empty_alternatives(spark, sf_dir):
    """How many of every repository's newest six decisions name no alternative."""
    return jobs.empty_share(decisions(spark, sf_dir), 6)


JOBS = EVENTS + """, jobs AS (SELECT user_id AS repo_id, event_id AS id, event_type AS job_type, CASE k % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'done' ELSE 'queued' END AS status,
  k AS dedupe_key, ts AS created_at, 10 * k AS latency_ms, k AS tokens, 'm' || k::VARCHAR AS message FROM ev)"""


def _jobs(spark, sf_dir):
    """Events as job records of their user's repository."""
    k = F.col("k")
    status = F.when(k % 3 == 0, "error").when(k % 3 == 1, "done").otherwise("queued")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("repo_id"), F.col("event_id").alias("id"), F.col("event_type").alias("job_type"), status.alias("status"), k.alias("dedupe_key"),
        F.col("ts").alias("created_at"), (10 * k).alias("latency_ms"), k.alias("tokens"), F.concat(F.lit("m"), k.cast("string")).alias("message"),
    )


@query("rank_failed_jobs", f"""WITH {JOBS} SELECT * FROM (SELECT repo_id, id, message, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, id) AS nth
 FROM jobs WHERE job_type = 'click' AND status = 'error') WHERE nth <= 4""")
def failed_jobs(spark, sf_dir):
    """The newest failed jobs of a kind in every repository."""
    return jobs.failed_jobs(_jobs(spark, sf_dir), "click", 4).select("repo_id", "id", "message", "nth")


@query("sync_not_done", f"""WITH {JOBS} SELECT repo_id, id, dedupe_key FROM jobs j WHERE status = 'queued' AND NOT EXISTS
 (SELECT 1 FROM jobs d WHERE d.status = 'done' AND d.repo_id = j.repo_id AND d.dedupe_key = j.dedupe_key + 2)""")
def not_done(spark, sf_dir):
    """K6: queued jobs but those whose key another record tells as done."""
    every = _jobs(spark, sf_dir)
    history = every.withColumn("dedupe_key", F.col("dedupe_key") - 2)
    return jobs.not_done(every.filter("status = 'queued'"), history, ["repo_id", "dedupe_key"]).select("repo_id", "id", "dedupe_key")


@query(
    "sync_register",
    """WITH w AS (SELECT 'local/r' || (o_custkey * 2)::VARCHAR AS name, max(CASE WHEN o_orderstatus = 'F' THEN 'b' || (o_orderkey % 5)::VARCHAR END) AS branch FROM orders GROUP BY 1),
r AS (SELECT 'local/r' || c_custkey::VARCHAR AS name, 'id' || c_custkey::VARCHAR AS repo_id, CASE WHEN c_nationkey % 2 = 0 THEN 'trunk' END AS old FROM customer)
SELECT name, coalesce(repo_id, sha256(name)) AS repo_id, coalesce(branch, old, 'main') AS branch, repo_id IS NULL AS created FROM w LEFT JOIN r USING (name)""",
)
def register(spark, sf_dir):
    """K7: repositories told by orders, found among those of customers or made."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    stored = c.select(
        F.concat(F.lit("local/r"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("repo_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "trunk").alias("branch"),
    )
    branch = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("b"), (F.col("o_orderkey") % 5).cast("string")))
    return jobs.register(stored, o.select(F.concat(F.lit("local/r"), (F.col("o_custkey") * 2).cast("string")).alias("name"), branch.alias("branch")))


@query("sync_clear", f"WITH {JOBS} SELECT repo_id, id FROM jobs WHERE repo_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 150)")
def clear(spark, sf_dir):
    """Job records but those of repositories to clear."""
    e = table(spark, sf_dir, "events")
    gone = e.groupBy(F.col("user_id").alias("repo_id")).agg(F.max("value").alias("top")).filter("top > 150")
    return jobs.cleared(_jobs(spark, sf_dir), gone).select("repo_id", "id")


@query(
    "sync_finish_jobs",
    f"""WITH {JOBS}, t AS (SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'done' ELSE 'error' END AS st, CASE WHEN k % 4 <> 1 THEN k + 7 END AS tk FROM ev WHERE event_type = 'view')
SELECT j.id, coalesce(st, status) AS status, CASE WHEN st IS NULL THEN latency_ms ELSE 3 END AS latency_ms, CASE WHEN st IS NULL THEN tokens ELSE coalesce(tk, 0) END AS tokens,
 CASE WHEN st IS NULL THEN message WHEN st = 'error' THEN 'e' END AS message FROM jobs j LEFT JOIN t USING (id)""",
)
def finish_jobs(spark, sf_dir):
    """Views end their job; a message stays with errors alone."""
    k = F.col("k")
    told = events(spark, sf_dir).filter("event_type = 'view'").select(
        F.col("event_id").alias("id"), F.when(k % 2 == 0, "done").otherwise("error").alias("status"), F.lit(3).alias("latency_ms"), F.when(k % 4 != 1, k + 7).alias("tokens"), F.lit("e").alias("message")
    )
    return jobs.finished(_jobs(spark, sf_dir), told).select("id", "status", "latency_ms", "tokens", "message")


@query("filter_pending", "SELECT l_orderkey AS id, l_linenumber AS part FROM lineitem WHERE l_linestatus <> 'F'")
def pending(spark, sf_dir):
    """Lines as chunks that are not embedded yet."""
    status = F.when(F.col("l_linestatus") == "F", "embedded").otherwise("pending")
    return jobs.pending(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), status.alias("status"))).drop("status")


@query(
    "scan_merged_pulls",
    f"""WITH {EVENTS}, p AS (SELECT event_id AS id, CASE WHEN k % 2 = 0 THEN 'm' || k::VARCHAR WHEN k % 3 = 0 THEN 'h' || k::VARCHAR ELSE 'tip' END AS source_sha, k FROM ev WHERE event_type = 'click')
SELECT id, source_sha, 'm' || k::VARCHAR || CASE WHEN k % 2 = 0 THEN '' ELSE ',' || source_sha END AS shas FROM p""",
)
def merged_pulls(spark, sf_dir):
    """Clicks as merged requests, with the commit they ended in and all they bring."""
    name = lambda mark: F.concat(F.lit(mark), F.col("k").cast("string"))
    pulls = events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", F.col("ts")).alias("merged_at"), F.when(F.col("k") % 2 == 0, name("m")).alias("merge_sha"),
        F.when(F.col("k") % 3 == 0, name("h")).alias("head_sha"), F.array(name("m")).alias("commit_shas"),
    )
    return jobs.merged_requests(pulls, F.lit("tip")).select("id", "source_sha", F.array_join("commit_shas", ",").alias("shas"))


@query(
    "sync_flush_deferred",
    f"""WITH {EVENTS}, r AS (SELECT user_id AS repo_id, arg_min('s' || k::VARCHAR, event_id) AS before, arg_max('s' || (k + 1)::VARCHAR, event_id) AS after,
 epoch_ms(max(ts)) AS updated_ms FROM ev WHERE event_type <> 'view' GROUP BY ALL),
done AS (SELECT DISTINCT user_id AS repo_id, 's' || k::VARCHAR AS after FROM ev WHERE event_type = 'view' AND k % 2 = 0), act AS (SELECT DISTINCT user_id AS repo_id, 's' || k::VARCHAR AS after FROM ev WHERE event_type = 'view' AND k % 2 = 1)
SELECT repo_id, before, after, CASE WHEN updated_ms + 86400000 <= (SELECT max(epoch_ms(ts)) FROM ev) THEN 'expired' WHEN (repo_id, after) IN (SELECT (repo_id, after) FROM done) THEN 'done'
 WHEN (repo_id, after) IN (SELECT (repo_id, after) FROM act) THEN 'active' ELSE 'flush' END AS action FROM r""",
)
def flush_deferred(spark, sf_dir):
    """What becomes of every deferred range when the index is ready; ranges live for a day here."""
    e = events(spark, sf_dir)
    late = e.filter("event_type <> 'view'")
    last = late.groupBy(F.col("user_id").alias("repo_id")).agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("updated_ms"))
    ranges = sync.coalesce_pushes(_pushes(late)).join(last, "repo_id")
    tips = e.filter("event_type = 'view'").select(F.col("user_id").alias("repo_id"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("after"), F.when(F.col("k") % 2 == 0, "done").otherwise("active").alias("status"))
    now = e.agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("now")).first()["now"] or 0
    return jobs.flush_plan(ranges, tips, tips.filter("status = 'active'"), now, 86_400_000).select("repo_id", "before", "after", "action")


@query(
    "agg_breaker_states",
    """WITH c AS (SELECT user_id AS provider, event_id AS id, event_id * 2000 AS ms, CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 500 ELSE 429 END AS status FROM events),
r AS (SELECT *, sum((status = 200)::INTEGER) OVER (PARTITION BY provider ORDER BY ms, id) AS run FROM c),
n AS (SELECT *, sum((status = 429)::INTEGER) OVER (PARTITION BY provider, run ORDER BY ms, id) AS nth FROM r),
t AS (SELECT *, CASE WHEN status = 200 THEN -1 WHEN status = 429 AND nth >= 2 THEN ms + 300000 WHEN status = 429 THEN -1 END AS told FROM n),
u AS (SELECT *, coalesce(last_value(told IGNORE NULLS) OVER (PARTITION BY provider ORDER BY ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS til FROM t)
SELECT provider, id, CASE WHEN til < 0 THEN 'closed' WHEN ms < til THEN 'open' ELSE 'half-open' END AS state FROM u""",
)
def breaker_states(spark, sf_dir):
    """The breaker's state before every call of every user as provider."""
    status = F.when(F.col("event_type") == "purchase", 200).when(F.col("event_type") == "signup", 500).otherwise(429)
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("provider"), F.col("event_id").alias("id"), (F.col("event_id") * 2000).alias("at_ms"), status.alias("status"))
    return jobs.breaker_states(calls).select("provider", "id", "state")


@query(
    "agg_cache_log",
    f"""WITH {EVENTS}, c AS (SELECT user_id::VARCHAR || '/' || (k % 3)::VARCHAR AS key, event_id AS id, event_id * 2000 AS ms, event_type = 'click' AS is_set, value * 4000 <= 262144 AS fits FROM ev),
s AS (SELECT *, last_value(CASE WHEN is_set AND fits THEN ms END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM c)
SELECT key, id, coalesce(ms < stored + 600000, false) AS hit FROM s WHERE NOT is_set""",
)
def cache_log(spark, sf_dir):
    """Whether every read finds what a click stored under its key."""
    e = events(spark, sf_dir)
    key = F.concat_ws("/", F.col("user_id").cast("string"), (F.col("k") % 3).cast("string"))
    calls = e.select(key.alias("key"), F.col("event_id").alias("id"), (F.col("event_id") * 2000).alias("at_ms"), F.when(F.col("event_type") == "click", "set").otherwise("get").alias("kind"), (F.col("value") * 4000).alias("bytes"))
    return jobs.cache_log(calls).select("key", "id", "hit")


@query("filter_scoped_tokens", f"WITH {EVENTS} SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN true WHEN 'signup' THEN false ELSE user_id % 100 = k END AS allowed FROM ev")
def scoped_tokens(spark, sf_dir):
    """whether every request's token reads the repository it asks for."""
    kind = F.when(F.col("event_type") == "purchase", "admin").when(F.col("event_type") == "signup", "none").otherwise("repo")
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), jobs.may_read(kind, F.col("user_id") % 100, F.col("k")).alias("allowed"))


@query(
    "agg_chunk_outcomes",
    """WITH a AS (SELECT l_orderkey AS chunk, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS good, count(*) FILTER (NOT (l_returnflag = 'A' AND l_linestatus = 'F')) AS bad FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN good > 0 THEN 'embedded' WHEN bad >= 3 THEN 'failed' ELSE 'due' END AS state FROM a""",
)
def chunk_outcomes(spark, sf_dir):
    """State of every order as a chunk, its lines being attempts."""
    ok = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    return jobs.chunk_outcomes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), ok.alias("ok")))


DOCS = """docs AS (SELECT source AS repo_id, doc_id AS id, text, CASE doc_id % 4 WHEN 0 THEN 'docs/decisions/' || doc_id::VARCHAR || '.md' WHEN 1 THEN 'docs/' || doc_id::VARCHAR || '.md'
  WHEN 2 THEN 'notes/adr-' || doc_id::VARCHAR || '.md' ELSE 'docs/decisions/.env.' || doc_id::VARCHAR || '.md' END AS file_path, doc_id % 8 = 0 AS split FROM documents)"""


def _docs(spark, sf_dir):
    """Documents as files of their source: half are decision-shaped, one in eight has two headings."""
    d, name = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    at = F.col("doc_id") % 4
    path = (
        F.when(at == 0, F.concat(F.lit("docs/decisions/"), name, F.lit(".md"))).when(at == 1, F.concat(F.lit("docs/"), name, F.lit(".md")))
        .when(at == 2, F.concat(F.lit("notes/adr-"), name, F.lit(".md"))).otherwise(F.concat(F.lit("docs/decisions/.env."), name, F.lit(".md")))
    )
    parts = F.concat(F.lit("## One\n"), F.col("text"), F.lit("\n## Two\nmore"))
    files = d.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("id"), path.alias("file_path"), F.when(F.col("doc_id") % 8 == 0, parts).otherwise(F.col("text")).alias("content"))
    based = files.select("repo_id").distinct().withColumn("https_base", F.when(F.col("repo_id") != "src3", F.concat(F.lit("https://example.org/"), F.col("repo_id"))))
    return files, based


@query(
    "sync_doc_run",
    f"""WITH {DOCS}, c AS (SELECT * FROM docs WHERE id % 4 IN (0, 2) AND repo_id <> 'src3' AND octet_length(encode(CASE WHEN split THEN '## One' || chr(10) || text || chr(10) || '## Two' || chr(10) || 'more' ELSE text END)) <= 3000
 AND NOT regexp_matches(text, '(?i)(postgres(ql)?|mysql|mongodb(\\+srv)?|redis|amqp)://[^\\s:@/]+:[^\\s@/]+@')),
s AS (SELECT repo_id, id, file_path, regexp_extract(file_path, '([^/]*)\\.md$', 1) AS topic, 1 AS sec FROM c WHERE NOT split AND trim(text) <> '' UNION ALL SELECT repo_id, id, file_path, unnest(['One', 'Two']), unnest([1, 2]) FROM c WHERE split),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, id, sec) AS nth FROM s) SELECT repo_id, id, topic, nth FROM n WHERE nth <= 10""",
)
def doc_run(spark, sf_dir):
    """Drafts that a run stores for every source, secret and large files skipped, the budget's last file cut."""
    files, based = _docs(spark, sf_dir)
    return jobs.doc_run(files, based, 10, 3000).select("repo_id", "id", "topic", "nth")


@query(
    "rank_rerank_results",
    """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
r AS (SELECT o_custkey AS query_id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE o_orderkey % 9 - 1 END::DOUBLE AS idx, o_totalprice AS score FROM orders WHERE o_orderstatus <> 'P'),
j AS (SELECT h.query_id, h.id, min(seq) AS seq, arg_min(score, seq) AS score FROM h JOIN r ON r.query_id = h.query_id AND r.idx = h.position - 1 GROUP BY ALL)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rerank FROM j""",
)
def rerank_results(spark, sf_dir):
    """A reranker's answers for every customer's list; odd, strange and repeated indexes are left out."""
    o = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    head = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), place.alias("position"))
    index = F.when(F.col("o_orderkey") % 5 == 0, 0.5).otherwise(F.col("o_orderkey") % 9 - 1)
    score = F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice"))
    return ranking.rerank_results(head, o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("seq"), index.alias("index"), score.alias("score")))
