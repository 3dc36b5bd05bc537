"""Queries on scalar functions, chunking and policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from citeloom.functions import ignore, policy, text
from citeloom.operators import chunking, decisions as decide
from citeloom.plans.base import DECISIONS, FILES, SOURCES, decisions, files, query, sources
from citeloom.plans.search import SPACE_SQL
from citeloom.session import table


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    "fn_sparse_tokens",
    """WITH r AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS raw FROM documents),
p AS (SELECT id, raw, list_distinct(list_filter([lower(raw)] || list_transform(string_split(regexp_replace(regexp_replace(replace(raw, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda x: lower(x)), lambda x: length(x) >= 2)) AS ts FROM r),
t AS (SELECT id, unnest(ts) AS term FROM p) SELECT id, term, count(*) AS tf FROM t GROUP BY ALL""",
)
def sparse_tokens(spark, sf_dir):
    """F1, F2, A2: term frequencies of every document."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(text.sparse_tokens(F.col("text"))).alias("term"))
    return t.groupBy("id", "term").agg(F.count("*").alias("tf"))


@query(
    "fn_bm25",
    """WITH r AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS raw FROM documents),
t AS (SELECT id, unnest(list_distinct(list_filter([lower(raw)] || list_transform(string_split(regexp_replace(regexp_replace(replace(raw, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda x: lower(x)), lambda x: length(x) >= 2))) AS term FROM r),
n AS (SELECT id, count(*)::DOUBLE AS n FROM t GROUP BY id), f AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t GROUP BY ALL)
SELECT id, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 180.0))), 6) AS weight, count(*) AS terms FROM f JOIN n USING (id) GROUP BY id""",
)
def bm25(spark, sf_dir):
    """summed document-side weights of every document."""
    from citeloom.operators.retrieval import postings

    return postings(files(spark, sf_dir)).groupBy("id").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("terms"))


@query(
    "fn_fnv1a",
    """WITH RECURSIVE t AS (SELECT DISTINCT lower(c_mktsegment) || (c_custkey % 50)::VARCHAR AS term FROM customer),
h AS (SELECT term, 0 AS i, 2166136261::BIGINT AS h FROM t UNION ALL
 SELECT term, i + 1, (xor(h, ascii(term[i + 1])::BIGINT) * 16777619) & 4294967295 FROM h WHERE i < length(term))
SELECT term, h AS hash FROM h WHERE i = length(term)""",
)
def fnv1a(spark, sf_dir):
    """hashes of every customer's segment and bucket."""
    t = table(spark, sf_dir, "customer").select(F.concat(F.lower("c_mktsegment"), (F.col("c_custkey") % 50).cast("string")).alias("term")).distinct()
    return t.select("term", text.fnv1a(F.col("term")).alias("hash"))


@query(
    "fn_paths",
    rf"""WITH {FILES}, p AS (SELECT id, CASE id % 7 WHEN 5 THEN 'plain words ' || id::VARCHAR WHEN 6 THEN '.t' || (id % 10)::VARCHAR WHEN 0 THEN file_path WHEN 1 THEN 'docs/x/decisions/' || file_path WHEN 2 THEN '.env.' || id::VARCHAR WHEN 3 THEN 'ADR-' || id::VARCHAR || '.md' ELSE 'dist/' || file_path END AS path FROM files)
SELECT id, path, split_part(path, '/', -1) AS base, CASE WHEN regexp_matches(path, '(?i)\.(md|mdx|rst|txt|adoc)$') THEN 'doc' ELSE 'source' END AS class,
 regexp_matches(split_part(path, '/', -1), '(?i)^adr.*\.md$') OR regexp_matches(path, '(?i)\.md$') AND regexp_matches(path, '(?i)(^|/)docs/(?:.+/)?decisions/') AS decision_doc,
 regexp_matches(path, '(?i)(^|/)\.env\.[^/]*$') AS secret, regexp_matches(path, '(?i)(^|/)\.env\.[^/]*$') OR regexp_matches(path, '(^|/)dist/') AS excluded, contains(path, '/') OR regexp_matches(path, '\.[A-Za-z0-9]{{1,8}}$') AS path_like, regexp_matches(path, '^\.[A-Za-z0-9]{{1,8}}$') AS bare_extension FROM p""",
)
def paths(spark, sf_dir):
    """Classes of every file's path."""
    f = files(spark, sf_dir)
    made = F.element_at(F.array(F.col("file_path"), F.concat(F.lit("docs/x/decisions/"), "file_path"), F.concat(F.lit(".env."), F.col("id").cast("string")), F.concat(F.lit("ADR-"), F.col("id").cast("string"), F.lit(".md")), F.concat(F.lit("dist/"), "file_path"), F.concat(F.lit("plain words "), F.col("id").cast("string")), F.concat(F.lit(".t"), (F.col("id") % 10).cast("string"))), (F.col("id") % 7 + 1).cast("int"))
    p = f.select("id", made.alias("path"))
    c = F.col("path")
    return p.select("id", "path", text.basename(c).alias("base"), text.path_class(c).alias("class"), text.is_decision_doc(c).alias("decision_doc"), policy.is_secret_path(c).alias("secret"), policy.is_excluded(c).alias("excluded"), text.is_path_like(c).alias("path_like"), text.is_extension_only(c).alias("bare_extension"))


# Rules of an ignore file for the paths of documents, and what they say of one path, written out.
RULES = ("# sources", "*.dat", "!*7.dat", "/src2*/", "de/*.MD", "**/fr/*1.txt", "!src3/**/fr/*", "es/", "!es/12*")
RULES_SQL = r"""CASE WHEN regexp_matches(file_path, '(?i)^src2[^/]*/') OR regexp_matches(file_path, '(^|/)es/') THEN true
 WHEN regexp_matches(file_path, '^src3/(.*/)?fr/[^/]+$') THEN false WHEN regexp_matches(file_path, '(^|/)fr/[^/]*1\.txt$') THEN true
 WHEN regexp_matches(file_path, '7\.dat$') THEN false ELSE regexp_matches(file_path, '\.dat$') END"""


@query("fn_ignored", f"WITH {FILES} SELECT id, file_path, {RULES_SQL} AS ignored FROM files")
def ignored(spark, sf_dir):
    """Every file by ordered ignore rules."""
    return files(spark, sf_dir).select("id", "file_path", ignore.is_ignored(F.col("file_path"), ignore.rules(RULES)).alias("ignored"))


@query(
    "fn_citations",
    f"""WITH {DECISIONS} SELECT id, source_url, starts_with(source_url, 'https://') AS citation, topic || E'\\n\\n' || summary || CASE WHEN len(alternatives) > 0 THEN E'\\n\\nAlternatives considered: ' || array_to_string(alternatives, '; ') ELSE '' END AS embed_text,
 'https://github.com/a/r' || repo_id::VARCHAR || '/commit/' || id::VARCHAR AS commit_url, 'https://github.com/a/r' || repo_id::VARCHAR || '/blob/' || id::VARCHAR || '/a%20b/' || id::VARCHAR || '.md#L3' AS blob_url,
 strftime(decided_at, '%Y-%m-%d') AS day, sha256('x|' || id::VARCHAR) AS job FROM decisions""",
)
def citations(spark, sf_dir):
    """Links, days and job ids of every decision."""
    d = decisions(spark, sf_dir)
    remote = F.concat(F.lit("git@github.com:a/r"), F.col("repo_id").cast("string"), F.lit(".git"))
    base, sha = text.github_base(remote), F.col("id").cast("string")
    path = F.concat(F.lit("a b/"), sha, F.lit(".md"))
    return d.select(
        "id", "source_url", text.is_citation(F.col("source_url")).alias("citation"), text.decision_text(F.col("topic"), F.col("summary"), F.col("alternatives")).alias("embed_text"),
        text.commit_link(base, F.lit("a"), sha).alias("commit_url"), text.blob_link(base, sha, path, F.lit(3)).alias("blob_url"),
        text.day_key(F.col("decided_at")).alias("day"), text.job_id(F.lit("x"), sha).alias("job"),
    )


@query(
    "fn_index_text",
    rf"""WITH {FILES} SELECT id, sha256(file_path || E'\n' || split_part(file_path, '/', -1) || CASE WHEN b = '' THEN '' ELSE E'\n\n' || b END) AS digest FROM (SELECT *, regexp_replace(content, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS b FROM files)""",
)
def index_text(spark, sf_dir):
    """Digest of every file's index text."""
    f = files(spark, sf_dir)
    return f.select("id", F.sha2(text.index_text(F.col("file_path"), F.lit(None).cast("string"), F.col("content")), 256).alias("digest"))


def _any_sql(column: str, patterns) -> str:
    return " OR ".join(f"regexp_matches({column}, '{_sql(p)}')" for p in patterns)


@query(
    "fn_trivial_sources",
    f"""WITH {SOURCES} SELECT id, title, NOT regexp_matches(title || E'\\n' || body, '{_sql(policy.RATIONALE)}') AND
 ((regexp_matches(title, '{policy.BARE_MERGE}') AND body = '') OR regexp_matches(title, '{_sql(policy.TRIVIAL_SUBJECT)}') OR {_any_sql('title', policy.TRIVIAL)}) AS trivial,
 {_any_sql('title', policy.CONTRAST)} AS contrast FROM sources""",
)
def trivial_sources(spark, sf_dir):
    """Every source message judged."""
    return sources(spark, sf_dir).select("id", "title", policy.is_trivial(F.col("title"), F.col("body")).alias("trivial"), policy.has_contrast(F.col("title")).alias("contrast"))


QUALITY = f"CASE WHEN len(alternatives) > 0 THEN 'filled' WHEN {_any_sql('summary', policy.CONTRAST)} THEN 'inconsistent' ELSE 'true_empty' END"


@query("agg_alternatives_audit", f"WITH {DECISIONS}, b AS (SELECT {QUALITY} AS bucket FROM decisions) SELECT bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 1)::DOUBLE AS percent FROM b GROUP BY bucket")
def alternatives_audit(spark, sf_dir):
    """Quality of every decision's alternatives."""
    return decide.audit(decisions(spark, sf_dir).withColumns({"title": F.lit(""), "body": F.lit("")}))


@query(
    "fn_redact",
    """SELECT doc_id AS id, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS keys, regexp_matches(text, '(?i)(password|secret|token|api_?key)\\s*=\\s*[A-Za-z0-9+/_\\-]{20,}') AS assigned,
 sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '[REDACTED:aws_access_key]', 'g'), 'sk-[A-Za-z0-9_\\-]{20,}', '[REDACTED:api_key]', 'g'),
 'ghp_[A-Za-z0-9]{20,}', '[REDACTED:github_pat]', 'g'), '-----BEGIN [A-Z ]*PRIVATE KEY-----', '[REDACTED:private_key]', 'g'), '(?i)(password|secret|token|api_?key)\\s*=\\s*[A-Za-z0-9+/_\\-]{20,}', '[REDACTED:assigned_secret]', 'g')) AS digest FROM documents""",
)
def redact(spark, sf_dir):
    """every document with its secrets blotted out."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.size(F.regexp_extract_all("text", F.lit(policy.SECRETS["aws_access_key"]), 0)).cast("long").alias("keys"),
        F.array_contains(policy.secret_hits(F.col("text")), "assigned_secret").alias("assigned"), F.sha2(policy.redacted(F.col("text")), 256).alias("digest"),
    )


CHUNK_COLUMNS = ("id", "file_path", "symbol", "parent", "language", "byte_start", "byte_end", "content_hash")
WINDOW_SQL = "unnest(list_filter(range(0, greatest(e - s, 1)::BIGINT, 1800), lambda o: e > s AND (o = 0 OR o < e - s - 200)))"


@query(
    "chunk_windows",
    f"""WITH p AS (SELECT page_id AS id, html AS content, 0 AS s, length(html) AS e FROM pages), w AS (SELECT *, {WINDOW_SQL} AS o FROM p)
SELECT id, 'pages/' || id::VARCHAR || '.html' AS file_path, NULL AS symbol, NULL AS parent, 'unknown(.html)' AS language, (s + o)::INTEGER AS byte_start, least(s + o + 2000, e)::INTEGER AS byte_end,
 sha256(substring(content, (s + o + 1)::BIGINT, (least(s + o + 2000, e) - s - o)::BIGINT)) AS content_hash FROM w""",
)
def chunk_windows(spark, sf_dir):
    """Overlapping windows of every page."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("content"))
    return chunking.windows(p).select(*CHUNK_COLUMNS)


# Sentences become headings of three depths and fence lines, by their first letters.
MARKED = ((r"\. ([A-C])", ".\n```\n$1"), (r"\. ([D-H])", ".\n# $1"), (r"\. ([I-O])", ".\n### $1"), (r"\. ([P-Z])", ".\n## $1"))
MARKED_SQL = reduce(lambda c, r: "regexp_replace(%s, '%s', E'%s', 'g')" % (c, r[0].replace("\\", "\\"), r[1].replace("\n", "\\n").replace("$1", "\\\\1")), MARKED, "text")


@query(
    "chunk_markdown",
    f"""WITH d AS (SELECT doc_id AS id, 'd/' || doc_id::VARCHAR || '.md' AS file_path, {MARKED_SQL} AS content FROM documents),
l AS (SELECT id, file_path, content, unnest(string_split(content, E'\\n')) AS line, generate_subscripts(string_split(content, E'\\n'), 1) AS n FROM d),
a AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
 regexp_matches(line, '^\\s*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS fences FROM l),
h AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})', 1)) AS depth, regexp_replace(regexp_extract(line, '^(#{{1,6}})[ \\t]+([^\\n]+?)[ \\t]*$', 2), '^{SPACE_SQL}+|[ \\t]+#+[ \\t]*$|{SPACE_SQL}+$', '', 'g') AS title
 FROM a WHERE NOT fence AND fences % 2 = 0 AND regexp_matches(line, '^(#{{1,6}})[ \\t]+([^\\n]+?)[ \\t]*$')),
t AS (SELECT * FROM h WHERE title <> ''),
u AS (SELECT id, n, max_by(other, above) AS parent FROM (SELECT t.id, t.n, p.n AS above, p.title AS other FROM t JOIN t AS p ON p.id = t.id AND p.n < t.n AND p.depth < t.depth) GROUP BY id, n),
s AS (SELECT t.id, file_path, content, title AS symbol, u.parent, pos AS s, coalesce(lead(pos) OVER (PARTITION BY t.id ORDER BY t.n), length(content)) AS e FROM t LEFT JOIN u ON u.id = t.id AND u.n = t.n
 UNION ALL SELECT d.id, file_path, content, NULL, NULL, 0, coalesce(low, length(content)) FROM d LEFT JOIN (SELECT id, min(pos) AS low FROM t GROUP BY id) AS f ON f.id = d.id),
w AS (SELECT *, {WINDOW_SQL} AS o FROM s)
SELECT id, file_path, symbol, parent, 'markdown' AS language, (s + o)::INTEGER AS byte_start, least(s + o + 2000, e)::INTEGER AS byte_end,
 sha256(substring(content, (s + o + 1)::BIGINT, (least(s + o + 2000, e) - s - o)::BIGINT)) AS content_hash FROM w""",
)
def chunk_markdown(spark, sf_dir):
    """Sections of every document, its sentences made headings of three depths, some within fences."""
    d = table(spark, sf_dir, "documents")
    body = reduce(lambda c, r: F.regexp_replace(c, *r), MARKED, F.col("text"))
    f = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), body.alias("content"))
    return chunking.markdown(f).select(*CHUNK_COLUMNS)


@query("chunk_files")
def chunk_files(spark, sf_dir):
    """Every file by the chunker of its extension (packing paragraphs is a fold, which SQL lacks)."""
    return chunking.chunk_files(files(spark, sf_dir), code=False).select(*CHUNK_COLUMNS)


@query("chunk_doc_sections")
def doc_sections(spark, sf_dir):
    """C11: decision drafts of every document's second-level sections."""
    d = table(spark, sf_dir, "documents")
    body = F.regexp_replace("text", r"\. ([A-Z])", ".\n## $1")
    return chunking.doc_sections(d.select(F.col("doc_id").alias("id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), body.alias("content")))
