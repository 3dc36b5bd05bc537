"""Queries on extraction, with a model that answers by rule."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from citeloom.operators import extraction, jobs, providers
from citeloom.plans.base import SOURCES, query, sources
from citeloom.plans.jobs import DOCS, _docs


def _answer(system: str, prompt: str) -> tuple[str, int]:
    """A model by rule: the number of the source's commit says how it answers."""
    n = int(re.search(r"\bs(\d+)\b", prompt)[1])
    one = lambda topic, summary, other, confidence: {"topic": topic, "summary": summary, "alternativesConsidered": other, "confidence": confidence, "touchedPaths": []}
    if prompt.startswith("These decisions"):
        return json.dumps({"decisions": [one(f"s{n}", "chose it", ["the other"] if n % 2 else [], 0.9)]}), 5
    good = json.dumps({"decisions": [one(f"s{n}", "chose one over two" if n % 4 == 0 else "simple", [], n % 10 / 10), one(f"s{n} b", "plain", ["x"], "0.7")]})
    if prompt.startswith("The last answer"):
        return ("still not" if n % 3 == 0 else good), 7
    return (f"no JSON for s{n}" if n % 5 == 0 else f"```json\n{good}\n```"), 10


def _refusing(system: str, prompt: str) -> tuple[str, int]:
    if int(re.search(r"\bs(\d+)\b", prompt)[1]) % 7 == 0:
        raise providers.Refused(500)
    return _answer(system, prompt)


def _gateway() -> providers.Gateway:
    return providers.Gateway((providers.Provider("first", "small", _refusing, 0), providers.Provider("second", "large", _answer, 1)))


@query(
    "decide_extract",
    f"""WITH {SOURCES}, s AS (SELECT id, title, substring(source_sha, 2)::INTEGER AS n, regexp_matches(title, '(?i)\\bchose\\b[\\s\\S]{{{{0,80}}}}\\bover\\b') AS contrast FROM sources),
r AS (SELECT *, n % 5 = 0 AS repaired, n % 5 = 0 AND n % 3 = 0 AS failed FROM s),
c AS (SELECT *, NOT failed AND (contrast OR n % 4 = 0) AS odd FROM r)
SELECT id, repaired, odd AS consistency_repaired, 10 + CASE WHEN repaired THEN 7 ELSE 0 END + CASE WHEN odd THEN 5 ELSE 0 END AS tokens,
 CASE WHEN n % 7 = 0 THEN 'second' ELSE 'first' END AS provider, CASE WHEN odd AND contrast AND n % 2 = 0 THEN 1 ELSE 0 END AS dropped, failed,
 CASE WHEN failed THEN 0 WHEN odd THEN CASE WHEN contrast AND n % 2 = 0 THEN 0 ELSE 1 END ELSE (n % 10 >= 5)::INTEGER + 1 END AS stored FROM c""".replace("{{", "{").replace("}}", "}"),
)
def extract(spark, sf_dir):
    """Every source asked, repaired and gated; sums, provider and drops of each."""
    found = extraction.extract(sources(spark, sf_dir), lambda rows: providers.completed(rows, _gateway, extraction.SYSTEM, deal=False))
    kept = F.filter("decisions", lambda d: d["confidence"] >= 0.5)
    return found.select("id", "repaired", "consistency_repaired", "tokens", "provider", "dropped", F.col("failure").isNotNull().alias("failed"), F.size(kept).alias("stored"))


@query(
    "sync_doc_records",
    f"""WITH {DOCS}, c AS (SELECT * FROM docs WHERE id % 4 IN (0, 2) AND repo_id <> 'src3' AND octet_length(encode(CASE WHEN split THEN '## One' || chr(10) || text || chr(10) || '## Two' || chr(10) || 'more' ELSE text END)) <= 3000
 AND NOT regexp_matches(text, '(?i)(postgres(ql)?|mysql|mongodb(\\+srv)?|redis|amqp)://[^\\s:@/]+:[^\\s@/]+@')),
s AS (SELECT repo_id, id, file_path, regexp_extract(file_path, '([^/]*)\\.md$', 1) AS topic, 1 AS line, 1 AS sec FROM c WHERE NOT split AND trim(text) <> ''
 UNION ALL SELECT repo_id, id, file_path, unnest(['One', 'Two']), unnest([1, 2 + len(string_split(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), chr(10)))]), unnest([1, 2]) FROM c WHERE split),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_path, id, sec) AS nth FROM s),
run AS (SELECT repo_id, sha256(concat_ws('|', repo_id, 'doc', file_path, line::VARCHAR)) AS id, topic, 'https://example.org/' || repo_id || '/blob/abc/' || file_path || '#L' || line::VARCHAR AS source_url, file_path, 'doc' AS source_type FROM n WHERE nth <= 10),
old AS (SELECT repo_id, 'old' || id::VARCHAR AS id, 'old' AS topic, 'https://example.org/' || id::VARCHAR AS source_url, file_path, CASE WHEN id % 3 = 0 THEN 'pr' ELSE 'doc' END AS source_type FROM docs)
SELECT * FROM run UNION ALL SELECT * FROM old WHERE source_type <> 'doc' OR (repo_id, file_path) NOT IN (SELECT (repo_id, file_path) FROM run)""",
)
def doc_records(spark, sf_dir):
    """What is stored after a run over documents, in place of the earlier records of the same files."""
    files, based = _docs(spark, sf_dir)
    run = extraction.doc_records(jobs.doc_run(files, based, 10, 3000), F.lit("abc"), F.lit("2024-01-01").cast("timestamp"))
    old = files.select(
        "repo_id", F.concat(F.lit("old"), F.col("id").cast("string")).alias("id"), F.lit("old").alias("topic"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("alternatives"),
        F.lit("2023-01-01").cast("timestamp").alias("decided_at"), F.when(F.col("id") % 3 == 0, "pr").otherwise("doc").alias("source_type"), F.concat(F.lit("https://example.org/"), F.col("id").cast("string")).alias("source_url"),
        F.lit("x").alias("source_sha"), F.array("file_path").alias("touched_paths"), F.lit(0.5).alias("confidence"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("superseded_by"),
    )
    return extraction.stored(old, run).select("repo_id", "id", "topic", "source_url", F.col("touched_paths")[0].alias("file_path"), "source_type")
