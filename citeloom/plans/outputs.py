"""Queries on paths, keys, formatted texts and the run budget of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import outputs, text
from citeloom.operators import jobs, metrics, retrieval
from citeloom.plans.base import DECISIONS, EVENTS, SOURCES, decisions, events, files, query, sources
from citeloom.plans.base import FILES
from citeloom.plans.search import SPACE_SQL
from citeloom.session import table


@query(
    "fn_paths_summary",
    """WITH l AS (SELECT l_orderkey AS id, list(DISTINCT 'p' || l_partkey::VARCHAR ORDER BY 'p' || l_partkey::VARCHAR) AS paths FROM lineitem GROUP BY l_orderkey)
SELECT id, 'Changed files (from git — use these for touchedPaths; do not invent paths):' || E'\\n' || array_to_string(list_transform(paths[1:2], lambda p: '- ' || p), E'\\n')
 || CASE WHEN len(paths) > 2 THEN E'\\n- …and ' || (len(paths) - 2)::VARCHAR || ' more' ELSE '' END AS summary FROM l""",
)
def paths_summary(spark, sf_dir):
    """Paths of every order's lines, the first two named."""
    l = table(spark, sf_dir, "lineitem")
    paths = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_set(F.concat(F.lit(" p"), F.col("l_partkey").cast("string")))).alias("paths"))
    return paths.select("id", outputs.paths_summary(text.changed_paths(F.col("paths")), 2).alias("summary"))


@query(
    "fn_resolve_paths",
    f"""WITH {EVENTS} SELECT event_id AS id, CASE WHEN k % 3 = 0 THEN 'a/' || k::VARCHAR || ',b' WHEN event_type = 'view' THEN 'git/' || k::VARCHAR WHEN event_type = 'click' THEN 'api/x' ELSE '' END AS paths,
 CASE WHEN k % 2 = 0 THEN 'b' ELSE 'b,c' END AS trusted FROM ev""",
)
def resolve_paths(spark, sf_dir):
    """Stored, then logged, then told paths of every event; claimed paths that are real."""
    k = F.col("k").cast("string")
    stored = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"touchedPaths":["a/'), k, F.lit('"," b ","b"]}'))).otherwise('{"x":1}')
    none = F.array().cast("array<string>")
    logged = F.when(F.col("event_type") == "view", F.array(F.concat(F.lit("git/"), k))).otherwise(none)
    told = F.when(F.col("event_type") == "click", F.array(F.lit("api/x"))).otherwise(none)
    claimed = F.when(F.col("k") % 2 == 0, F.array(F.lit("z"), F.lit("b"))).otherwise(F.array(F.lit("z")))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.array_join(outputs.first_filled(outputs.touched_paths(stored), logged, told), ",").alias("paths"),
        F.array_join(outputs.trusted_paths(claimed, F.array(F.lit("b"), F.lit("c"))), ",").alias("trusted"),
    )


@query(
    "fn_cache_keys",
    """SELECT o_orderkey AS id, sha256('{"limit":10,"query":' || to_json(o_orderpriority)::VARCHAR || '}|' || o_custkey::VARCHAR || '|' || epoch_ms(o_orderdate)::VARCHAR) AS key,
 epoch_ms(o_orderdate) AS epoch, CASE WHEN o_orderkey % 2 = 0 THEN sha256('t' || o_orderkey::VARCHAR) END AS token FROM orders""",
)
def cache_keys(spark, sf_dir):
    """cache key, epoch and token digest of every order."""
    o = table(spark, sf_dir, "orders")
    header = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Bearer t").otherwise("Basic t"), F.col("o_orderkey").cast("string"))
    epoch = text.epoch_of(F.col("o_orderdate"), F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"))
    options = F.struct(F.lit(10).alias("limit"), F.col("o_orderpriority").alias("query"))
    return o.select(F.col("o_orderkey").alias("id"), outputs.cache_key(options, F.col("o_custkey").cast("string"), epoch).alias("key"), epoch.alias("epoch"), outputs.bearer(header).alias("token"))


@query(
    "fn_result_lines",
    rf"""WITH {FILES} SELECT id, '1. ' || file_path || ' (' || printf('%.3f', id / 7.0) || ') ' || left(regexp_replace(regexp_replace(content, '{SPACE_SQL}+', ' ', 'g'), '^ | $', '', 'g'), 200) AS line FROM files""",
)
def result_lines(spark, sf_dir):
    """a line for every file."""
    return files(spark, sf_dir).select("id", outputs.hit_line(F.lit(1), F.col("file_path"), F.col("id") / F.lit(7.0), F.col("content")).alias("line"))


@query(
    "fn_prompts",
    f"""WITH {SOURCES} SELECT id, sha256('Source type: ' || source_type || E'\\nSource URL: ' || coalesce(source_url, '') || E'\\nSource SHA: ' || source_sha || E'\\nTitle: ' || title || E'\\n\\nBody:\\n' || body
 || CASE WHEN k % 2 = 0 THEN E'\\n\\nDiff summary:\\n- x' ELSE '' END) AS digest FROM sources""",
)
def prompts(spark, sf_dir):
    """digest of every source's prompt."""
    s = sources(spark, sf_dir)
    diff = F.when(F.col("k") % 2 == 0, "- x")
    made = outputs.extraction_prompt(F.col("source_type"), F.coalesce("source_url", F.lit("")), F.col("source_sha"), F.col("title"), F.col("body"), diff)
    return s.select("id", F.sha2(made, 256).alias("digest"))


@query("filter_touched", f"WITH {DECISIONS}, t AS (SELECT DISTINCT 'src' || (c_custkey % 20)::VARCHAR || '/none' AS p FROM customer WHERE c_nationkey = 3) SELECT id, repo_id FROM decisions WHERE source_type = 'doc' AND list_has_any(touched_paths, (SELECT list(p) FROM t))")
def touched(spark, sf_dir):
    """Document decisions that touch any of a set of paths, as a semi-join."""
    c = table(spark, sf_dir, "customer").filter("c_nationkey = 3")
    wanted = c.select(F.concat(F.lit("src"), (F.col("c_custkey") % 20).cast("string"), F.lit("/none")).alias("p")).distinct()
    return retrieval.touching(decisions(spark, sf_dir), wanted.withColumnRenamed("p", "path"))


@query(
    "sync_run_budget",
    """WITH l AS (SELECT o_custkey AS run, l_orderkey AS file, l_linenumber AS section, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT * FROM l WHERE nth <= 10""",
)
def run_budget(spark, sf_dir):
    """The budget rule of C12 alone, over lines as sections (the whole run: sync_doc_run)."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("run"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("section"))
    return jobs.within_budget(rows, "run", ("file", "section"), 10)


@query(
    "agg_counts",
    """SELECT user_id AS repo_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') > 0 AS any_failed FROM events GROUP BY user_id""",
)
def counts(spark, sf_dir):
    """Counts of every user's jobs by state, and whether any failed."""
    return metrics.counts(table(spark, sf_dir, "events").withColumnRenamed("user_id", "repo_id"), "repo_id", "event_type", "error")


@query("rank_newest", """SELECT * FROM (SELECT o_custkey AS repo_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders) WHERE nth <= 5""")
def newest(spark, sf_dir):
    """Newest five of every repository."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return jobs.newest(rows, "o_orderdate", 5).drop("o_orderdate")


@query(
    "fn_diff_summary",
    f"""WITH {FILES}, p AS (SELECT id, list_transform(range(0, id % 60), lambda i: 'src/' || i::VARCHAR || '.ts') AS paths, regexp_replace(content, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS t FROM files),
s AS (SELECT id, paths, CASE WHEN length(t) > 4096 THEN substring(t, 1, 4096) || E'\\n…(stat truncated)' WHEN t <> '' THEN t END AS stat FROM p),
b AS (SELECT id, CASE WHEN len(paths) > 0 THEN 'Changed files (from git — use these for touchedPaths; do not invent paths):' || E'\\n' || array_to_string(list_transform(paths[1:40], lambda x: '- ' || x), E'\\n')
 || CASE WHEN len(paths) > 40 THEN E'\\n- …and ' || (len(paths) - 40)::VARCHAR || ' more' ELSE '' END END AS head, 'Diff stat:' || E'\\n' || stat AS tail FROM s)
SELECT id, sha256(concat_ws(E'\\n\\n', head, tail)) AS digest FROM b""",
)
def diff_summaries(spark, sf_dir):
    """changed paths and statistic of every file, the statistic cut."""
    paths = F.transform(F.when(F.col("id") % 60 > 0, F.sequence(F.lit(0), (F.col("id") % 60 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("src/"), i.cast("string"), F.lit(".ts")))
    return files(spark, sf_dir).select("id", F.sha2(outputs.diff_summary(paths, outputs.stat_summary(F.col("content"))), 256).alias("digest"))


@query(
    "fn_decision_lines",
    f"""WITH {DECISIONS} SELECT id, '3. ' || topic || CASE WHEN id % 2 = 0 THEN ' [superseded]' ELSE ' [active]' END || ' (confidence=' || printf('%.2f', (id % 7) / 7.0) || ', retrievalScore=' || printf('%.4f', (id % 16) / 16.0) || E')\\n' || summary
 || E'\\nAlternatives: ' || CASE WHEN len(alternatives) > 0 THEN array_to_string(alternatives, '; ') ELSE '(none recorded)' END || E'\\nSource: ' || source_url AS line FROM decisions""",
)
def decision_lines(spark, sf_dir):
    """every decision as it is shown when found."""
    line = outputs.decision_lines(F.lit(3), F.col("topic"), F.col("summary"), F.col("alternatives"), F.col("source_url"), (F.col("id") % 7) / F.lit(7.0), (F.col("id") % 16) / F.lit(16.0), F.col("id") % 2 == 0)
    return decisions(spark, sf_dir).select("id", line.alias("line"))


@query(
    "fn_explained_text",
    f"""WITH {DECISIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY id) AS nth FROM decisions),
d AS (SELECT repo_id, string_agg(nth::VARCHAR || '. ' || topic || CASE WHEN id % 2 = 0 THEN ' [superseded] (' ELSE ' [active] (' END || strftime(decided_at, '%Y-%m-%d') || E')\\n' || summary || E'\\nSource: ' || source_url, E'\\n\\n' ORDER BY nth) AS related,
 string_agg(nth::VARCHAR || '. ' || topic, E'\\n' ORDER BY nth) AS chunks FROM n GROUP BY repo_id)
SELECT c_custkey AS repo_id, sha256('File: f' || c_custkey::VARCHAR || E'\\n\\nChunks:\\n' || coalesce(chunks, 'No indexed chunks for this path.') || E'\\n\\nRelated decisions:\\n' || coalesce(related, 'No related decisions.')) AS digest
 FROM customer LEFT JOIN d ON repo_id = c_custkey""",
)
def explained_texts(spark, sf_dir):
    """what is told of every customer as a file, with orders as its decisions."""
    d = decisions(spark, sf_dir)
    one = F.struct("id", "topic", (F.col("id") % 2 == 0).alias("superseded"), F.date_format("decided_at", "yyyy-MM-dd").alias("decided_at"), "summary", "source_url")
    lists = d.groupBy("repo_id").agg(F.array_sort(F.collect_list(one)).alias("related"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id")).join(lists, "repo_id", "left")
    related = F.coalesce("related", F.array().cast(lists.schema["related"].dataType))
    text_ = outputs.explained_text(F.concat(F.lit("f"), F.col("repo_id").cast("string")), F.transform(related, lambda x: x["topic"]), related)
    return c.select("repo_id", F.sha2(text_, 256).alias("digest"))
