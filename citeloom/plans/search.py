"""Queries on ranking and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators import index as indexes
from citeloom.operators import ranking, retrieval
from citeloom.plans.base import DECISIONS, FILES, asked, decisions, files, query
from citeloom.session import table

HEX = "'0123456789abcdef'"


def _bag(name: str, source: str, key: str, body: str) -> str:
    """Counts of a bag-of-words vector by dimension, with its norm."""
    return f"""{name}_t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({body}), '[A-Za-z_][A-Za-z0-9_]+')) AS t FROM {source}),
{name}_c AS (SELECT id, ((strpos({HEX}, sha256(t)[7]) - 1) * 16 + strpos({HEX}, sha256(t)[8]) - 1) % 32 AS dim, count(*)::DOUBLE AS n FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(n * n)) AS norm FROM {name}_c GROUP BY id),
{name}_v AS (SELECT id, dim, n / norm AS w FROM {name}_c JOIN {name}_n USING (id))"""


def _tokens(name: str, source: str, key: str, body: str) -> str:
    return f"""{name}_r AS (SELECT {key} AS id, unnest(regexp_extract_all({body}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS raw FROM {source}),
{name} AS (SELECT id, unnest(list_distinct(list_filter([lower(raw)] || list_transform(string_split(regexp_replace(regexp_replace(replace(raw, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda x: lower(x)), lambda x: length(x) >= 2))) AS term FROM {name}_r)"""


def _channels(source: str, body: str, prefetch: int, floor: float, scoped: bool = False) -> str:
    own = f"JOIN {source} own ON own.id = %s.id JOIN asked ON asked.query_id = %s AND asked.repo_id = own.repo_id" if scoped else ""
    in_dense, in_sparse = (own % ("d_v", "q_v.id"), own % ("post", "qtf.query_id")) if scoped else ("", "")
    return f"""{_bag('d', source, 'id', body)}, {_bag('q', 'asked', 'query_id', 'query')},
dense AS (SELECT q_v.id AS query_id, d_v.id, round(sum(d_v.w * q_v.w), 6) AS score FROM d_v JOIN q_v USING (dim) {in_dense} GROUP BY ALL HAVING round(sum(d_v.w * q_v.w), 6) >= {floor}),
{_tokens('dt', source, 'id', body)}, {_tokens('qt', 'asked', 'query_id', 'query')},
len AS (SELECT id, count(*) AS n FROM dt GROUP BY id),
tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM dt GROUP BY ALL),
post AS (SELECT id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 180.0)) AS weight FROM tf JOIN len USING (id)),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM {source}) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
qtf AS (SELECT id AS query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
sparse AS (SELECT qtf.query_id, post.id, round(sum(qtf * weight * idf), 6) AS score FROM qtf JOIN post USING (term) JOIN idf USING (term) {in_sparse} GROUP BY ALL),
ranks AS (SELECT * FROM (SELECT query_id, id, 'dense' AS channel, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM dense) WHERE rank < {prefetch}
 UNION ALL SELECT * FROM (SELECT query_id, id, 'sparse' AS channel, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sparse) WHERE rank < {prefetch}),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (rank + 3)), 6) AS score, coalesce(max(score) FILTER (channel = 'dense'), 0) AS evidence,
 bool_or(channel = 'dense') AS in_dense, bool_or(channel = 'sparse') AS in_sparse FROM ranks GROUP BY query_id, id)"""


def _cutoff(limit: int) -> str:
    return f"""top AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, max(score) FILTER (in_dense AND in_sparse) OVER (PARTITION BY query_id) AS top_dual FROM fused),
strong AS (SELECT *, coalesce(in_dense AND in_sparse AND score >= 0.5 * top_dual, false) AS strong FROM top),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, strong ORDER BY score DESC, id) AS nth FROM strong),
stage AS (SELECT *, CASE WHEN top_dual IS NULL THEN CASE WHEN score >= 0.5 * top THEN 0 END
 WHEN strong THEN CASE WHEN nth <= {max(1, limit // 2)} THEN 0 ELSE 2 END
 WHEN in_dense AND NOT in_sparse AND score >= 0.5 * top_dual THEN 0
 WHEN in_dense AND in_sparse THEN 1 WHEN score >= 0.166667 THEN 1 END AS stage FROM nth),
sub AS (SELECT *, CASE WHEN stage <> 1 THEN 0 WHEN in_dense AND NOT in_sparse THEN 0 WHEN in_dense THEN 1 ELSE 2 END AS sub FROM stage WHERE stage IS NOT NULL),
cut AS (SELECT * FROM (SELECT query_id, id, score, evidence, row_number() OVER (PARTITION BY query_id ORDER BY stage, sub, score DESC, id) AS position FROM sub) WHERE position <= {limit})"""


ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
SPACE_SQL = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _diversify(limit: int) -> str:
    return rf"""one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY position) AS pn FROM rows_) WHERE pn = 1),
cls AS (SELECT *, regexp_matches(file_path, '(?i)\.(md|mdx|rst|txt|adoc)$') AS doc FROM one),
late AS (SELECT *, CASE WHEN doc AND max((NOT doc)::INTEGER) OVER (PARTITION BY query_id) = 1
 AND row_number() OVER (PARTITION BY query_id, doc ORDER BY position) > {limit // 2} THEN 1 ELSE 0 END AS late FROM cls),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, position) AS place FROM late)"""


@query(
    "rank_search_codebase",
    f"""WITH {FILES}, {ASKED}, {_channels('files', 'content', 60, 0.35)}, {_cutoff(20)},
rows_ AS (SELECT query_id, position, id, file_path, score, evidence FROM cut JOIN files USING (id)
 WHERE evidence >= 0.35 AND NOT regexp_matches(content, '(?i)(postgres(ql)?|mysql|mongodb(\\+srv)?|redis|amqp)://[^\\s:@/]+:[^\\s@/]+@')),
{_diversify(10)} SELECT query_id, place AS position, id, file_path, score, evidence FROM placed WHERE place <= 10""",
)
def search_codebase(spark, sf_dir):
    """Dense and sparse channels, fusion, cutoff, hydration, diversification."""
    return retrieval.search(files(spark, sf_dir), asked(spark, sf_dir), 10, lexical=False)


@query(
    "rank_scoped_search",
    f"""WITH {FILES.replace("SELECT doc_id AS id,", "SELECT doc_id AS id, source AS repo_id,")},
asked AS (SELECT item_id AS query_id, text AS query, 'src' || (item_id % 20)::VARCHAR AS repo_id FROM benchmark), {_channels('files', 'content', 30, 0.35, True)}, {_cutoff(10)},
rows_ AS (SELECT query_id, position, id, file_path, score, evidence FROM cut JOIN files USING (id)
 WHERE evidence >= 0.35 AND NOT regexp_matches(content, '(?i)(postgres(ql)?|mysql|mongodb(\\+srv)?|redis|amqp)://[^\\s:@/]+:[^\\s@/]+@')),
{_diversify(5)} SELECT query_id, place AS position, id, file_path, score, evidence FROM placed WHERE place <= 5""",
)
def scoped_search(spark, sf_dir):
    """Every benchmark passage asked in one source alone; the other sources' documents are never paired with it."""
    rows = files(spark, sf_dir).withColumn("repo_id", F.split("file_path", "/")[0])
    queries = asked(spark, sf_dir).withColumn("repo_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return retrieval.search(rows, queries, 5, lexical=False)


@query("rank_hybrid_cutoff", f"WITH {FILES}, {ASKED}, {_channels('files', 'content', 60, 0.35)}, {_cutoff(20)} SELECT * FROM cut")
def hybrid(spark, sf_dir):
    """Fused ranks after the staged cutoff."""
    return retrieval.hybrid(indexes.build(files(spark, sf_dir)), asked(spark, sf_dir), 60, 0.35, 20)


@query(
    "rank_find_decision",
    f"""WITH {DECISIONS}, asked AS (SELECT row_number() OVER (ORDER BY p) AS query_id, 'order ' || p || ' speed' AS query FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)),
docs AS (SELECT *, topic || E'\\n\\n' || summary || CASE WHEN len(alternatives) > 0 THEN E'\\n\\nAlternatives considered: ' || array_to_string(alternatives, '; ') ELSE '' END AS content FROM decisions),
{_channels('docs', 'content', 48, 0.45)}, {_cutoff(16)},
few AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS fn FROM cut WHERE evidence > 0),
live AS (SELECT query_id, id, topic, source_url, score, evidence, max(evidence) OVER (PARTITION BY query_id) AS best FROM few JOIN docs USING (id) WHERE fn <= 8 AND starts_with(source_url, 'https://')),
nthd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence DESC, id) AS position FROM live WHERE best >= 0.58 AND evidence >= best * 0.85)
SELECT query_id, position, id, topic, source_url, score, evidence FROM nthd WHERE position <= 3""",
)
def find_decision(spark, sf_dir):
    """Decisions for every priority's name, all orders being one repository's."""
    found = decisions(spark, sf_dir).drop("repo_id").withColumn("superseded_by", F.lit(None).cast("long"))
    names = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    from pyspark.sql import Window

    queries = names.select(F.row_number().over(Window.orderBy("o_orderpriority")).alias("query_id"), F.concat(F.lit("order "), "o_orderpriority", F.lit(" speed")).alias("query"))
    return retrieval.find_decisions(found, queries)


@query(
    "rank_lexical",
    """WITH rows_ AS (SELECT p_partkey AS id, p_name AS symbol, p_type || '/' || p_brand AS file_path FROM part),
a AS (SELECT DISTINCT p_brand AS q FROM part),
k AS (SELECT q AS query_id, id, CASE WHEN symbol = q THEN 'symbol_exact' WHEN file_path = q OR split_part(file_path, '/', -1) = q THEN 'path_exact'
 WHEN ends_with(file_path, '/' || q) THEN 'path_suffix' WHEN contains(lower(symbol), lower(q)) THEN 'symbol_soft' END AS kind FROM rows_, a
 WHERE symbol = q OR file_path = q OR contains(lower(symbol), lower(q)) OR contains(lower(file_path), lower(q))),
s AS (SELECT *, CASE kind WHEN 'symbol_exact' THEN 1.0 WHEN 'path_exact' THEN 0.98 WHEN 'path_suffix' THEN 0.92 ELSE 0.75 END::DOUBLE AS score,
 CASE kind WHEN 'symbol_soft' THEN 0.4 ELSE 1.0 END::DOUBLE AS evidence FROM k WHERE kind IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM s)
SELECT query_id, id, kind, score, evidence, nth FROM n WHERE nth <= 20""",
)
def lexical(spark, sf_dir):
    """Lexical hits of every brand over parts as paths and symbols."""
    p = table(spark, sf_dir, "part")
    chunks = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"), F.concat_ws("/", "p_type", "p_brand").alias("file_path"), F.lit("").alias("content"))
    return retrieval.lexical_hits(chunks, p.select(F.col("p_brand").alias("query_id"), F.col("p_brand").alias("query")).distinct())


@query(
    "rank_merge_lexical",
    """WITH h AS (SELECT user_id AS query_id, event_id AS id, round(1.0::DOUBLE / (2 + row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)), 6) AS score, round(value / 1000, 6) AS evidence FROM events WHERE event_type <> 'click'),
l AS (SELECT user_id AS query_id, event_id AS id, CASE WHEN event_type = 'view' THEN 0.98 ELSE 0.75 END::DOUBLE AS lex, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.4 END::DOUBLE AS lev FROM events WHERE event_type IN ('view', 'click')),
j AS (SELECT query_id, id, coalesce(lev >= 1, false) AS exact, coalesce(h.score, round(0.3333333333333333::DOUBLE * lex, 6)) AS base, greatest(coalesce(evidence, 0), coalesce(lev, 0)) AS evidence FROM h FULL JOIN l USING (query_id, id)),
s AS (SELECT *, CASE WHEN exact THEN greatest(base, 0.333333) ELSE base END AS score FROM j)
SELECT query_id, id, score, evidence, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, id) AS position FROM s""",
)
def merge_lexical(spark, sf_dir):
    """Hybrid and lexical lists of every user's events."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "event_type", "value")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "id"))
    hybrid_list = e.filter("event_type <> 'click'").select("query_id", "id", F.round(F.lit(1.0) / (nth + 2), 6).alias("score"), F.round(F.col("value") / 1000, 6).alias("evidence"))
    view = F.col("event_type") == "view"
    lex = e.filter("event_type in ('view', 'click')").select("query_id", "id", F.when(view, 0.98).otherwise(0.75).alias("score"), F.when(view, 1.0).otherwise(0.4).alias("evidence"))
    return ranking.merge_lexical(hybrid_list, lex)


@query(
    "rank_diversify",
    f"""WITH rows_ AS (SELECT o_custkey AS query_id, o_orderkey AS id, 'p' || (o_orderkey % 11)::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '.md' ELSE '.ts' END AS file_path,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders), {_diversify(5)}
SELECT query_id, id, file_path, place AS position FROM placed WHERE place <= 5""",
)
def diversify(spark, sf_dir):
    """Best order of each path, documents at most half, for every customer."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("p"), (F.col("o_orderkey") % 11).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".md").otherwise(".ts"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return ranking.diversify(o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), path.alias("file_path"), nth.alias("position")), 5)


@query(
    "rank_floors",
    """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, round(o_totalprice / 500000, 6) AS evidence FROM orders),
t AS (SELECT *, max(evidence) OVER (PARTITION BY query_id) AS top FROM h) SELECT query_id, id, evidence FROM t WHERE top >= 0.58 AND evidence >= top * 0.85""",
)
def floors(spark, sf_dir):
    """List-level and relative floors over every customer's orders."""
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 500000, 6).alias("evidence"))
    return ranking.relative_floor(ranking.absolute_floor(h, 0.58), 0.85)


@query(
    "rank_rerank",
    """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders),
r AS (SELECT o_custkey AS query_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rr FROM orders WHERE o_orderstatus = 'F')
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN h.position <= 20 AND rr IS NOT NULL THEN 0 WHEN h.position <= 20 THEN 1 ELSE 2 END,
 CASE WHEN h.position <= 20 THEN coalesce(rr, 1073741824) END, h.position) AS position FROM h LEFT JOIN r USING (query_id, id)""",
)
def rerank(spark, sf_dir):
    """A reranker's order for the head of every customer's list."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice", "o_orderstatus")
    by = Window.partitionBy("query_id")
    hits = o.select("query_id", "id", F.row_number().over(by.orderBy("o_orderdate", "id")).alias("position"))
    ranks = o.filter("o_orderstatus = 'F'").select("query_id", "id", F.row_number().over(by.orderBy(F.desc("o_totalprice"), "id")).alias("rerank"))
    return ranking.reorder(hits, ranks)


@query(
    "rank_explain_file",
    rf"""WITH {FILES}, {DECISIONS},
c AS (SELECT file_path AS path, 1 AS nth, trim(regexp_replace(content, '{SPACE_SQL}+', ' ', 'g')) AS flat, length(content) AS n FROM files),
l AS (SELECT path, 'chunk' AS kind, nth, '[0-' || n::VARCHAR || '] ' || left(flat, 160) || CASE WHEN length(flat) > 160 THEN '…' ELSE '' END AS line FROM c),
t AS (SELECT DISTINCT file_path AS path, d.id, topic, source_url, decided_at FROM (SELECT *, unnest(touched_paths) AS tp FROM decisions) d
 JOIN (SELECT file_path, unnest([split_part(file_path, '/', 1), split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2), file_path]) AS tp FROM files) USING (tp) WHERE starts_with(source_url, 'https://'))
SELECT * FROM l UNION ALL SELECT path, 'decision', row_number() OVER (PARTITION BY path ORDER BY decided_at DESC, id), topic || ' | ' || source_url FROM t""",
)
def explain_file(spark, sf_dir):
    """Every file's summary and the decisions that touch it or a folder above it."""
    f = files(spark, sf_dir)
    chunks = f.withColumns({"symbol": F.lit(None).cast("string"), "byte_start": F.lit(0), "byte_end": F.length("content")})
    return retrieval.explain_file(chunks, decisions(spark, sf_dir), f.select(F.col("file_path").alias("path")))
