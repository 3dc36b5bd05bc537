"""Search over chunks: dense, sparse and lexical channels and the three public queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.config import SETTINGS
from citeloom.functions import policy, text
from citeloom.operators import index as indexes
from citeloom.operators import ranking
from citeloom.session import keep


def _scope(rows: DataFrame, queries: DataFrame) -> list[str]:
    """The columns that a query's repository is matched by; a scoped index refuses queries without a repository."""
    if "repo_id" not in rows.columns:
        return []
    if "repo_id" not in queries.columns:
        raise ValueError("queries on rows of several repositories need a repo_id")
    return ["repo_id"]


def postings(chunks: DataFrame, content: str = "content") -> DataFrame:
    """(id, term, weight): document-side BM25 term weights, with ``repo_id`` where the chunks have one."""
    keys = [c for c in ("repo_id", "id") if c in chunks.columns]
    tokens = chunks.select(*keys, text.sparse_tokens(F.col(content)).alias("tokens"))
    long = tokens.select(*keys, F.greatest(F.size("tokens"), F.lit(1)).alias("length"), F.explode("tokens").alias("term"))
    tf = long.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    return tf.select(*keys, "term", text.bm25_tf(F.col("tf").cast("double"), F.col("length").cast("double")).alias("weight"))


def lexical_hits(chunks: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Best lexical matches of each query on symbol, path and content."""
    scope = _scope(chunks, queries)
    found = indexes.lexical_candidates(chunks, queries.select("query_id", *scope, text.lexical_query(F.col("query")).alias("q")), scope)
    found = found.join(chunks.select("id", *scope, "content"), ["id", *scope])
    kind = text.lexical_match(F.col("q"), F.col("file_path"), F.col("symbol"), F.col("content"))
    scored = found.withColumn("kind", kind).filter("kind is not null").withColumns(
        {"score": text.lexical_score(F.col("kind")), "evidence": text.lexical_evidence(F.col("kind"))}
    )
    paths_first = (text.is_path_like(F.col("q")) & F.col("kind").isin("path_exact", "path_suffix")).cast("int")
    order = Window.partitionBy("query_id").orderBy(F.desc(paths_first), F.desc("score"), "id")
    top = scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max(1, min(50, limit)))
    return top.select("query_id", "id", "kind", "score", "evidence", "nth")


def hybrid(index: DataFrame, queries: DataFrame, prefetch: int, floor: float, limit: int, embed: indexes.Embed = indexes.bag, mode: str = "hybrid") -> DataFrame:
    """Fused hits of a stored index (see ``operators.index``) after the staged cutoff.

    ``mode`` ``dense`` reads the vectors alone: their order and scores stand.
    """
    channels = ("dense",) if mode == "dense" else ("dense", "sparse")
    found = keep(indexes.nearest(index, queries, prefetch, floor, embed, channels)).withColumn("score", F.round("score", 6))  # one reading for both channels
    dense = ranking.ranked(found.filter(F.col("channel") == "dense").filter(F.col("score") >= floor), "dense", prefetch)
    if mode == "dense":
        return dense.filter(F.col("rank") < limit).select("query_id", "id", "score", F.col("score").alias("evidence"), (F.col("rank") + 1).alias("position"))
    sparse = ranking.ranked(found.filter(F.col("channel") == "sparse"), "sparse", prefetch)
    return ranking.hybrid_cutoff(ranking.fuse(dense.unionByName(sparse)), limit)


def search(
    chunks: DataFrame, queries: DataFrame, top_k: int = 10, floor: float = SETTINGS.search_evidence_floor, lexical: bool = True, rerank=None,
    index: DataFrame | None = None, embed: indexes.Embed = indexes.bag, mode: str = "hybrid",
) -> DataFrame:
    """Cited chunks for each (query_id, query): (query_id, position, id, file_path, score, evidence).

    ``chunks`` has id, file_path, symbol, content, and ``repo_id`` where there
    are several repositories: then queries name theirs and find nothing else.
    ``index`` is what ``index.build(chunks, embed)`` wrote, or is built now.
    ``rerank``, if given, orders the head (see ``ranking.reranked``). Ranking runs on ids and
    scores alone; content joins only the few that are left.
    """
    fetch = max(2 * top_k, top_k + 5)
    prefetch = max(3 * fetch, 30)
    _scope(chunks, queries)
    hits = hybrid(indexes.build(chunks, embed) if index is None else index, queries, prefetch, floor, fetch, embed, mode)
    if lexical:
        hits = ranking.merge_lexical(hits, lexical_hits(chunks, queries))
    rows = hydrated(hits, chunks)
    rows = rows.filter((text.trimmed(F.col("file_path")) != "") & ~policy.must_refuse(F.col("file_path"), F.col("content")) & (F.col("evidence") >= floor))
    if rerank is not None:
        rows = ranking.reranked(rows, rerank)
    return ranking.diversify(rows, top_k).select("query_id", "position", "id", "file_path", "score", "evidence")


def find_decisions(
    decisions: DataFrame, queries: DataFrame, limit: int = 3, history: bool = False, floor: float = SETTINGS.find_evidence_floor, index: DataFrame | None = None, embed: indexes.Embed = indexes.bag
) -> DataFrame:
    """Cited decisions for each query, best first, above list-level and relative floors of evidence."""
    fetch = max(2 * limit, 8)
    cut = max(2 * fetch, fetch + 5)
    prefetch = max(3 * cut, 24)
    body = text.decision_text(F.col("topic"), F.col("summary"), F.col("alternatives"))
    docs = decisions.withColumn("content", body)
    _scope(docs, queries)
    hits = hybrid(indexes.build(docs, embed) if index is None else index, queries, prefetch, SETTINGS.find_dense_floor, cut, embed).filter("evidence > 0")
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).filter(F.col("nth") <= fetch)
    rows = hydrated(hits, decisions).filter(text.is_citation(F.col("source_url")))
    if not history:
        rows = rows.filter("superseded_by is null")
    rows = ranking.relative_floor(ranking.absolute_floor(rows, floor), SETTINGS.decision_relative_floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("evidence"), "id")
    rows = rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return rows.select("query_id", "position", "id", "topic", "source_url", "score", "evidence")


def hydrated(hits: DataFrame, rows: DataFrame, missing: bool = False) -> DataFrame:
    """Hits with their stored rows; hits whose row is gone are dropped, or kept with nulls if ``missing``."""
    return hits.join(rows, "id", "left" if missing else "inner")


def touching(decisions: DataFrame, paths: DataFrame) -> DataFrame:
    """Document decisions that touch any of ``paths`` (repo_id where both have it, path)."""
    scope = [c for c in ("repo_id",) if c in paths.columns]
    touched = decisions.filter("source_type = 'doc'").select("id", "repo_id", F.explode("touched_paths").alias("path"))
    return touched.join(paths.distinct(), [*scope, "path"], "left_semi").select("id", "repo_id").distinct()


def explain_file(chunks: DataFrame, decisions: DataFrame, paths: DataFrame) -> DataFrame:
    """For each path: chunk summaries in order, then cited decisions that touch it, newest first."""
    asked = paths.filter(~policy.is_secret_path(F.col("path")))
    own = chunks.join(asked, chunks["file_path"] == asked["path"]).filter(~policy.must_refuse(F.col("file_path"), F.col("content")))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("byte_start", "id"))
    lines = own.withColumn("nth", nth).filter(F.col("nth") <= SETTINGS.explain_summaries)
    lines = lines.select("path", F.lit("chunk").alias("kind"), "nth", text.chunk_summary(F.col("symbol"), F.col("byte_start"), F.col("byte_end"), F.col("content")).alias("line"))
    touched = decisions.select("id", "topic", "summary", "source_url", "decided_at", F.explode("touched_paths").alias("touched"))
    # A touched path is the asked one or a folder above it: an equi-join on the asked path's prefixes.
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = asked.select("path", F.explode(prefixes).alias("touched"))
    found = touched.join(above, "touched").filter(text.is_citation(F.col("source_url"))).dropDuplicates(["path", "id"])
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("decided_at"), "id"))
    related = found.select("path", F.lit("decision").alias("kind"), newest.alias("nth"), F.concat_ws(" | ", "topic", "source_url").alias("line"))
    return lines.unionByName(related)
