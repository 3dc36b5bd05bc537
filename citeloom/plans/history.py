"""Queries on incremental planning, decisions, jobs and evaluations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import decisions as decide
from citeloom.operators import metrics, retrieval, sync
from citeloom.plans.base import EVENTS, SOURCES, events, query, sources
from citeloom.session import table


@query(
    "sync_select_sources",
    None,
)
def select_sources(spark, sf_dir):
    """Outcome of every source, commits covered by merge requests left out."""
    return sync.select_sources(sources(spark, sf_dir)).select("id", "repo_id", "source_type", "outcome")


def _select_sql() -> str:
    from citeloom.functions import policy

    quoted = lambda p: p.replace("'", "''")
    trivial = " OR ".join(f"regexp_matches(title, '{quoted(p)}')" for p in (policy.TRIVIAL_SUBJECT, *policy.TRIVIAL))
    return f"""WITH {SOURCES}, j AS (SELECT *, CASE WHEN source_url IS NULL THEN 'unusable' WHEN NOT regexp_matches(title || E'\\n' || body, '{quoted(policy.RATIONALE)}')
 AND ((regexp_matches(title, '(?i)^merge(?:$|[^A-Za-z0-9_])') AND body = '') OR {trivial}) THEN 'trivial' ELSE 'selected' END AS o FROM sources),
c AS (SELECT DISTINCT repo_id, unnest(list_append(commit_shas, source_sha)) AS source_sha FROM j WHERE o = 'selected' AND source_type = 'pr')
SELECT id, repo_id, source_type, CASE WHEN o = 'selected' AND source_type <> 'pr' AND c.source_sha IS NOT NULL THEN 'covered' ELSE o END AS outcome FROM j LEFT JOIN c USING (repo_id, source_sha)"""


from citeloom.plans.base import SQL  # noqa: E402

SQL["sync_select_sources"] = _select_sql()
_OUTCOMES = ("selected", "trivial", "covered", "unusable")


@query("agg_skip_counts", f"SELECT repo_id, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in _OUTCOMES)} FROM ({_select_sql()}) GROUP BY repo_id")
def skip_counts(spark, sf_dir):
    """A10: sources of every repository that were taken, and left out for each reason."""
    return sync.skip_counts(sync.select_sources(sources(spark, sf_dir)))


@query(
    "sync_reuse",
    """WITH h AS (SELECT o_custkey AS repo_id, o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN 'k' || (o_orderkey % 3)::VARCHAR || o_orderpriority END AS dedupe_key, o_orderkey % 7 AS tokens, o_orderstatus FROM orders),
old AS (SELECT * FROM h WHERE o_orderstatus <> 'O' QUALIFY dedupe_key IS NULL OR row_number() OVER (PARTITION BY repo_id, dedupe_key ORDER BY id) = 1),
new AS (SELECT * FROM h WHERE o_orderstatus = 'O' QUALIFY dedupe_key IS NULL OR row_number() OVER (PARTITION BY repo_id, dedupe_key ORDER BY id) = 1)
SELECT old.repo_id, old.id, CASE WHEN new.id IS NULL THEN 'done' ELSE 'running' END AS status, CASE WHEN new.id IS NULL THEN old.tokens ELSE 0 END AS tokens_used FROM old LEFT JOIN new ON new.repo_id = old.repo_id AND new.dedupe_key = old.dedupe_key
UNION ALL SELECT repo_id, id, 'running', 0 FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.repo_id = new.repo_id AND old.dedupe_key = new.dedupe_key)""",
)
def reuse(spark, sf_dir):
    """K5: orders as jobs; open ones start the known ones of their key again, counters at 0."""
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("k"), (F.col("o_orderkey") % 3).cast("string"), "o_orderpriority"))
    rows = o.select(
        F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("id"), key.alias("dedupe_key"), F.lit("done").alias("status"), (F.col("o_orderkey") % 7).alias("tokens_used"),
        F.lit(5).alias("latency_ms"), F.lit("e").alias("error_message"), (F.col("o_orderstatus") == "O").alias("open"),
    )
    history = sync.first_by_key(rows.filter("not open").drop("open"), ["repo_id"], "dedupe_key", "id")
    return sync.reuse(history, rows.filter("open").drop("open"), ["repo_id"]).select("repo_id", "id", "status", "tokens_used")


@query(
    "sync_name_status",
    """WITH l AS (SELECT o_orderkey AS id, 'a' || o_custkey::VARCHAR AS a, 'b' || o_orderkey::VARCHAR AS b, ['A', 'M', 'D', 'R100', 'C75', 'T'][o_orderkey % 6 + 1] AS st FROM orders)
SELECT id, a AS path, CASE st WHEN 'A' THEN 'added' WHEN 'M' THEN 'modified' ELSE 'deleted' END AS kind FROM l WHERE st IN ('A', 'M', 'D', 'R100')
UNION ALL SELECT id, b, 'added' FROM l WHERE st IN ('R100', 'C75')""",
)
def name_status(spark, sf_dir):
    """changes told by status lines made of every order."""
    status = F.element_at(F.array(*[F.lit(x) for x in ("A", "M", "D", "R100", "C75", "T")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    line = F.concat_ws("\t", status, F.concat(F.lit("a"), F.col("o_custkey").cast("string")), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")))
    return sync.classify_status_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), line.alias("line")))


@query(
    "sync_compare_files",
    """WITH f AS (SELECT o_orderkey AS id, 'f' || o_orderkey::VARCHAR AS f, CASE WHEN o_orderkey % 8 = 6 THEN 'p' || o_custkey::VARCHAR END AS p,
 ['added', 'Copied', 'modified', 'changed', 'removed', 'other', 'renamed', 'renamed'][o_orderkey % 8 + 1] AS st FROM orders)
SELECT id, f AS path, CASE WHEN st IN ('added', 'Copied', 'renamed') THEN 'added' WHEN st = 'removed' THEN 'deleted' ELSE 'modified' END AS kind FROM f WHERE st <> 'other'
UNION ALL SELECT id, p, 'deleted' FROM f WHERE st = 'renamed' AND p IS NOT NULL""",
)
def compare_files(spark, sf_dir):
    """changes told by compared files made of every order."""
    names = ("added", "Copied", "modified", "changed", "removed", "other", "renamed", "renamed")
    status = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filename"), status.alias("status"),
        F.when(F.col("o_orderkey") % 8 == 6, F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("previous_filename"),
    )
    return sync.classify_compare_files(o)


@query(
    "sync_chunk_plan",
    """WITH o AS (SELECT l_suppkey AS file_path, md5((l_partkey % 300)::VARCHAR) AS content_hash, l_orderkey * 10 + l_linenumber AS id, l_shipdate < DATE '1995-06-01' AS old FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY file_path, content_hash, old ORDER BY id) AS nth FROM o),
j AS (SELECT file_path, content_hash, a.id AS old_id, b.id AS new_id FROM (SELECT * FROM n WHERE old) a FULL JOIN (SELECT * FROM n WHERE NOT old) b USING (file_path, content_hash, nth))
SELECT file_path, content_hash, coalesce(old_id, new_id) AS id, CASE WHEN new_id IS NULL THEN 'delete' WHEN old_id IS NULL THEN 'insert' ELSE 'keep' END AS action FROM j""",
)
def chunk_plan(spark, sf_dir):
    """One-to-one matching of hashes of older and newer line items, by supplier."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file_path"), F.md5((F.col("l_partkey") % 300).cast("string")).alias("content_hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_shipdate"
    )
    old = F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")
    return sync.plan_chunk_sync(rows.filter(old).drop("l_shipdate"), rows.filter(~old).drop("l_shipdate"))


@query(
    "sync_upsert",
    f"""WITH {EVENTS}, b AS (SELECT user_id, event_type, k, event_id, value, (event_type IN ('click', 'view'))::INTEGER AS fresh FROM ev)
SELECT user_id, k, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY fresh DESC, event_id DESC) AS n FROM b) WHERE n = 1""",
)
def upsert(spark, sf_dir):
    """The last event of each user and key; clicks and views are the changes."""
    e = events(spark, sf_dir)
    fresh = F.col("event_type").isin("click", "view")
    cols = ["user_id", "k", "event_id", "value"]
    return sync.upsert(e.filter(~fresh).select(*cols), e.filter(fresh).select(*cols), ["user_id", "k"], "event_id")


@query(
    "sync_first_by_key",
    f"""WITH {EVENTS}, r AS (SELECT user_id AS repo_id, event_type AS job_type, CASE WHEN k % 5 <> 0 THEN k END AS dedupe_key, event_id AS id FROM ev)
SELECT * FROM r WHERE dedupe_key IS NULL UNION ALL SELECT repo_id, job_type, dedupe_key, min(id) FROM r WHERE dedupe_key IS NOT NULL GROUP BY ALL""",
)
def first_by_key(spark, sf_dir):
    """K5: first job of each idempotency key, all of those without one."""
    e = events(spark, sf_dir)
    rows = e.select(F.col("user_id").alias("repo_id"), F.col("event_type").alias("job_type"), F.when(F.col("k") % 5 != 0, F.col("k")).alias("dedupe_key"), F.col("event_id").alias("id"))
    return sync.first_by_key(rows, ["repo_id", "job_type"], "dedupe_key", "id")


@query("sync_retention", "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-02-10' - INTERVAL 30 DAYS GROUP BY event_type")
def retention(spark, sf_dir):
    """Jobs past 30 days."""
    e = table(spark, sf_dir, "events")
    return e.filter(sync.expired(e, datetime(2024, 2, 10), 30, "ts")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "sync_coalesce_pushes",
    f"""WITH {EVENTS} SELECT user_id AS repo_id, arg_min('s' || k::VARCHAR, event_id) AS before, arg_max('s' || (k + 1)::VARCHAR, event_id) AS after, count(*) AS pushes FROM ev GROUP BY ALL""",
)
def coalesce_pushes(spark, sf_dir):
    """R2: pending range of every user's pushes."""
    return sync.coalesce_pushes(_pushes(events(spark, sf_dir)))


def _pushes(e):
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    return e.select(F.col("user_id").alias("repo_id"), F.col("event_type").alias("ref"), name(F.col("k")).alias("before"), name(F.col("k") + 1).alias("after"), F.col("event_id").alias("ord"), "ts")


@query(
    "sync_job_plans",
    """WITH s AS (SELECT user_id AS job_id, CASE WHEN max(value) > 300 THEN 'active' ELSE 'idle' END AS state FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT job_id, CASE WHEN state = 'active' THEN 'skip' WHEN state IS NULL THEN 'add' ELSE 'replace' END AS action FROM (SELECT DISTINCT user_id AS job_id FROM events) LEFT JOIN s USING (job_id)""",
)
def job_plans(spark, sf_dir):
    """K8: what happens to each user's job, by its state."""
    e = table(spark, sf_dir, "events")
    states = e.filter("event_type = 'error'").groupBy(F.col("user_id").alias("job_id")).agg(F.when(F.max("value") > 300, "active").otherwise("idle").alias("state"))
    return sync.replace_plan(e.select(F.col("user_id").alias("job_id")).distinct(), states)


@query(
    "sync_recovery",
    f"""WITH {EVENTS}, r AS (SELECT user_id, sum(k) - 40 * count(*) AS pending, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type IN ('error', 'click')) AS total,
 count(*) FILTER (event_type = 'view') AS queued, CASE WHEN count(*) % 4 = 0 THEN 'ready' ELSE 'indexing' END AS status FROM ev GROUP BY user_id)
SELECT *, CASE WHEN status <> 'indexing' THEN 'unchanged' WHEN pending <= 0 THEN CASE WHEN total > 0 AND failed >= total THEN 'error' ELSE 'finalize' END
 WHEN total = 0 THEN 'error' WHEN queued = 0 THEN 'error' ELSE 'unchanged' END AS action FROM r""",
)
def recovery(spark, sf_dir):
    """What becomes of every user's run."""
    e = events(spark, sf_dir)
    kind = F.col("event_type")
    runs = e.groupBy("user_id").agg(
        (F.sum("k") - 40 * F.count("*")).alias("pending"), F.count_if(kind == "error").alias("failed"), F.count_if(kind.isin("error", "click")).alias("total"),
        F.count_if(kind == "view").alias("queued"), F.when(F.count("*") % 4 == 0, "ready").otherwise("indexing").alias("status"),
    )
    return sync.recovery(runs)


@query(
    "agg_token_budget",
    """WITH j AS (SELECT user_id AS repo_id, event_id AS id, ts, floor(value * 10)::BIGINT AS tokens, strftime(ts, '%Y-%m-%d') AS day FROM events),
u AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY repo_id, day ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM j)
SELECT repo_id, id, tokens, used, used < 500 AS admitted FROM u""",
)
def token_budget(spark, sf_dir):
    """Jobs admitted by each user's daily tokens."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("id"), "ts", F.floor(F.col("value") * 10).cast("long").alias("tokens"))
    return metrics.token_budget(e, 500).select("repo_id", "id", "tokens", "used", "admitted")


@query(
    "agg_progress",
    """WITH c AS (SELECT l_suppkey AS repo_id, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' OR l_suppkey % 3 = 0 THEN 'embedded' ELSE 'pending' END AS status FROM lineitem),
a AS (SELECT repo_id, count(*) AS total, count(*) FILTER (status = 'embedded') AS done, count(*) FILTER (status = 'failed') AS failed FROM c GROUP BY repo_id)
SELECT *, total - done - failed AS pending, CASE WHEN total - done - failed > 0 THEN 'indexing' WHEN total > 0 AND failed = total THEN 'error' ELSE 'ready' END AS state FROM a""",
)
def progress(spark, sf_dir):
    """State of every supplier's run over its line items."""
    status = F.when(F.col("l_returnflag") == "R", "failed").when((F.col("l_linestatus") == "F") | (F.col("l_suppkey") % 3 == 0), "embedded").otherwise("pending")
    return metrics.progress(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("repo_id"), status.alias("status")))


@query(
    "agg_latency",
    f"""WITH {EVENTS}, c AS (SELECT event_type AS tool, value AS latency_ms, k::DOUBLE AS embed_ms, k % 2 = 0 AS hit FROM ev)
SELECT tool, count(*) AS calls, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(greatest(latency_ms - embed_ms, 0), 0.95), 6) AS p95_bare, round(avg(hit::INTEGER), 6) AS hit_rate FROM c GROUP BY tool""",
)
def latency(spark, sf_dir):
    """Percentiles and hit rates of every kind of event."""
    c = events(spark, sf_dir).select(F.col("event_type").alias("tool"), F.col("value").alias("latency_ms"), F.col("k").cast("double").alias("embed_ms"), (F.col("k") % 2 == 0).alias("hit"))
    return metrics.latency(c)


@query(
    "agg_breaker",
    """WITH c AS (SELECT user_id AS provider, event_id AS id, ts, CASE event_type WHEN 'purchase' THEN 200 WHEN 'signup' THEN 500 ELSE 429 END AS status FROM events),
r AS (SELECT *, sum((status = 200)::INTEGER) OVER (PARTITION BY provider ORDER BY ts, id) AS run FROM c WHERE status <> 500),
n AS (SELECT provider, id, row_number() OVER (PARTITION BY provider, run ORDER BY ts, id) AS nth FROM r WHERE status = 429) SELECT * FROM n WHERE nth >= 2""",
)
def breaker(spark, sf_dir):
    """W9 in part (see agg_breaker_states): refusals in a row of every user as provider."""
    status = F.when(F.col("event_type") == "purchase", 200).when(F.col("event_type") == "signup", 500).otherwise(429)
    c = table(spark, sf_dir, "events").select(F.col("user_id").alias("provider"), F.col("event_id").alias("id"), "ts", status.alias("status"))
    return metrics.breaker_trips(c).drop("ts")


@query(
    "eval_gates",
    """WITH s AS (SELECT ['search_codebase', 'find_decision', 'explain_file'][event_id % 3 + 1] AS tool, value > 5 AS passed, value >= 0 AS citation_ok, value > 50 AS content_ok FROM events),
a AS (SELECT coalesce(count(*) FILTER (passed AND tool = 'search_codebase') / nullif(count(*) FILTER (tool = 'search_codebase'), 0), 1.0) AS search_rate,
 coalesce(count(*) FILTER (citation_ok AND tool = 'find_decision') / nullif(count(*) FILTER (tool = 'find_decision'), 0), 1.0) AS citation_rate,
 count(*) FILTER (content_ok AND tool = 'find_decision') AS content_passed, count(*) FILTER (passed AND tool = 'explain_file') AS explain_passed FROM s)
SELECT *, search_rate >= 0.8 AND citation_rate >= 1.0 AS passed FROM a""",
)
def eval_gates(spark, sf_dir):
    """Rates and gates over every event as a scored query."""
    tool = F.element_at(F.array(*[F.lit(x) for x in ("search_codebase", "find_decision", "explain_file")]), (F.col("event_id") % 3 + 1).cast("int"))
    return metrics.evaluation(table(spark, sf_dir, "events").select(tool.alias("tool"), (F.col("value") > 5).alias("passed"), (F.col("value") >= 0).alias("citation_ok"), (F.col("value") > 50).alias("content_ok")))


@query("eval_replay", "SELECT count(*) FILTER (value <= 1 AND event_type = 'error') AS hard_failures, count(*) FILTER (value <= 1 AND event_type <> 'error') AS soft_failures, count(*) FILTER (value <= 1 AND event_type = 'error') = 0 AS ok FROM events")
def eval_replay(spark, sf_dir):
    """Failures of hard and soft cases."""
    gate = F.when(F.col("event_type") == "error", "hard").otherwise("soft")
    return metrics.replay(table(spark, sf_dir, "events").select((F.col("value") > 1).alias("passed"), gate.alias("gate")))


@query(
    "agg_endpoints",
    "WITH e AS (SELECT p_brand AS kind, p_partkey AS id, p_size AS priority FROM part WHERE p_size % 3 <> 0) SELECT kind, id, priority, row_number() OVER (PARTITION BY kind ORDER BY priority, id) AS nth FROM e",
)
def endpoints(spark, sf_dir):
    """Enabled parts of each brand by size."""
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("priority"), (F.col("p_size") % 3 != 0).alias("enabled"))
    return metrics.endpoint_order(e).drop("enabled")


@query(
    "join_decision_sources",
    """SELECT o_orderkey AS id, l_linenumber AS line, o_totalprice AS price FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') l ON l_orderkey = o_orderkey""",
)
def decision_sources(spark, sf_dir):
    """Orders with their returned lines, those without any kept."""
    o, returned = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    hits = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return retrieval.hydrated(hits, returned.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")), missing=True).select("id", "line", "price")


@query("join_supersede_chain", """WITH RECURSIVE d AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders),
c AS (SELECT id AS head, id, nxt, 0 AS depth FROM d UNION ALL SELECT c.head, d.id, d.nxt, depth + 1 FROM c JOIN d ON d.id = c.nxt)
SELECT head AS id, id AS latest, depth FROM c WHERE nxt IS NULL""")
def supersede_chain(spark, sf_dir):
    """The end of every order's chain of successors, each superseded by its customer's next."""
    o = table(spark, sf_dir, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return decide.chain(o.select(F.col("o_orderkey").alias("id"), after.alias("superseded_by")))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = F.zip_with("embedding", F.array_repeat(norm, F.size("embedding")), lambda x, n: x.cast("double") / n)  # within a transform the norm would be taken for each component
    return e.select(
        (F.col("vec_id") % 97).alias("repo_id"), F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), (F.col("vec_id") * 7919 % 1009).alias("decided_at"),
        F.when(F.col("label") == 0, "doc").otherwise("pr").alias("source_type"), v.alias("vector"),
    )


@query(
    "join_supersede_once",
    """WITH v AS (SELECT vec_id % 97 AS repo_id, vec_id AS id, vec_id * 7919 % 1009 AS decided_at, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label <> 0),
p AS (SELECT a.repo_id, a.id, b.id AS other, a.decided_at > b.decided_at AS newer, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.repo_id = b.repo_id AND b.id < a.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS nth FROM p WHERE score >= 0.25)
SELECT repo_id, CASE WHEN newer THEN other ELSE id END AS id, CASE WHEN newer THEN id ELSE other END AS superseded_by, score FROM n WHERE nth = 1""",
)
def supersede_once(spark, sf_dir):
    """Each vector's nearest earlier one in its group, in a single pass."""
    return decide.supersede_once(_vectors(spark, sf_dir), 0.25)


@query("join_supersede_ordered")
def supersede_ordered(spark, sf_dir):
    """Links in order of processing, each seeing those before, settled in rounds (tested against a plain fold)."""
    return decide.supersede(_vectors(spark, sf_dir), 0.25)


@query(
    "fn_parse_output",
    """WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN false ELSE length(text) > 0 END AS valid, CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN 1 ELSE 1 END AS n,
 CASE turn % 4 WHEN 3 THEN NULL ELSE left(text, 50) END AS topic FROM c""",
)
def parse_output(spark, sf_dir):
    """every answer wrapped as an object, an array, a fenced record or broken output, and read again."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    item = F.to_json(F.struct(F.substring("text", 1, 50).alias("topic"), F.col("text").alias("summary"), F.lit("0.5").alias("confidence")))
    raw = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit('Here: {"decisions":['), item, F.lit("]} done")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("["), item, F.lit("] tail")))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("```json\n"), item, F.lit("\n```")))
        .otherwise(F.concat(F.lit("none {"), item))
    )
    read = decide.parsed(c.select("conv_id", "turn", raw.alias("raw")))
    return read.select("conv_id", "turn", "valid", F.when(F.col("decisions").isNotNull(), F.size("decisions")).alias("n"), F.get("decisions", F.lit(0))["topic"].alias("topic"))
