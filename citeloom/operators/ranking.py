"""Rank fusion, cutoffs, merging and diversification, for many queries at once.

Every operator keeps ``query_id`` as its partition key: windows stay within one
query's candidates, which are few once the channels are cut to their best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.config import SETTINGS
from citeloom.functions.text import doc_slots, path_class, trimmed

BEST_SINGLE = 1.0 / (SETTINGS.rrf_k + 1)


def ranked(hits: DataFrame, channel: str, limit: int) -> DataFrame:
    """(query_id, id, channel, rank from 0, score) of the best ``limit`` hits of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < limit).select(
        "query_id", "id", F.lit(channel).alias("channel"), "rank", "score"
    )


def fuse(ranks: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of channels: score, best dense evidence and channels of each id."""
    part = F.lit(1.0) / (F.col("rank") + SETTINGS.rrf_k + 1)
    return ranks.groupBy("query_id", "id").agg(
        F.round(F.sum(part), 6).alias("score"),
        F.coalesce(F.max(F.when(F.col("channel") == "dense", F.col("score"))), F.lit(0.0)).alias("evidence"),
        F.max((F.col("channel") == "dense").cast("int")).alias("in_dense"),
        F.max((F.col("channel") == "sparse").cast("int")).alias("in_sparse"),
    )


def hybrid_cutoff(fused: DataFrame, limit: int, floor: float = SETTINGS.relative_floor, backfill: bool = True, min_channels: int = 2) -> DataFrame:
    """Hits in both channels first, at most half of them; then single-channel hits of good rank.

    Stage 0: strong hits of both channels (at least ``floor`` times the best
    such) up to half the limit, and dense hits as good. Stage 1: other dense
    hits, weak hits of both channels, sparse hits; single ones must be near the
    top of their channel. Stage 2: strong hits of both channels beyond the half.
    With ``min_channels`` 1 channels do not count: hits of at least ``floor`` times the best.
    """
    query = Window.partitionBy("query_id")
    dual = (F.col("in_dense") == 1) & (F.col("in_sparse") == 1)
    best = fused.withColumns({
        "top": F.max("score").over(query),
        "top_dual": F.max(F.when(dual, F.col("score"))).over(query),
    })
    strong = dual & (F.col("score") >= floor * F.col("top_dual"))
    dense_only = (F.col("in_dense") == 1) & (F.col("in_sparse") == 0)
    dual_order = Window.partitionBy("query_id", strong).orderBy(F.desc("score"), "id")
    best = best.withColumn("nth_strong", F.when(strong, F.row_number().over(dual_order)))
    no_dual = F.col("top_dual").isNull()
    if min_channels <= 1:
        kept = best.filter(F.col("score") >= floor * F.col("top")).withColumns({"stage": F.lit(0), "sub": F.lit(0)})
    elif not backfill:
        kept = best.filter(F.when(no_dual, F.col("score") >= floor * F.col("top")).otherwise(strong)).withColumns({"stage": F.lit(0), "sub": F.lit(0)})
    else:
        half = max(1, limit // 2)
        stage = (
            F.when(no_dual, F.when(F.col("score") >= floor * F.col("top"), 0))
            .when(strong, F.when(F.col("nth_strong") <= half, 0).otherwise(2))
            .when(dense_only & (F.col("score") >= floor * F.col("top_dual")), 0)
            .when(dual, 1)
            .when(F.col("score") >= round(BEST_SINGLE * floor, 6), 1)
        )
        sub = F.when(F.col("stage") != 1, 0).when(dense_only, 0).when(dual, 1).otherwise(2)
        kept = best.withColumn("stage", stage).filter("stage is not null").withColumn("sub", sub)
    order = Window.partitionBy("query_id").orderBy("stage", "sub", F.desc("score"), "id")
    kept = kept.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return kept.select("query_id", "id", "score", "evidence", "position")


def merge_lexical(hybrid: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full outer merge: exact lexical hits first, then by score; (query_id, id, score, evidence, position)."""
    lex = lexical.select("query_id", "id", F.col("score").alias("lex"), F.col("evidence").alias("lex_evidence"), (F.col("evidence") >= 1).alias("exact"))
    both = hybrid.select("query_id", "id", "score", "evidence").join(lex, ["query_id", "id"], "full")
    exact = F.coalesce("exact", F.lit(False))
    base = F.coalesce("score", F.round(F.lit(BEST_SINGLE) * F.col("lex"), 6))
    both = both.withColumns({
        "exact": exact,
        "score": F.when(exact, F.greatest(base, F.round(F.lit(BEST_SINGLE), 6))).otherwise(base),
        "evidence": F.greatest(F.coalesce("evidence", F.lit(0.0)), F.coalesce("lex_evidence", F.lit(0.0))),
    })
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("score"), "id")
    return both.withColumn("position", F.row_number().over(order)).select("query_id", "id", "score", "evidence", "position")


def relative_floor(hits: DataFrame, floor: float, by: str = "evidence") -> DataFrame:
    """Keep hits of at least ``floor`` times their query's best; all if that best or the floor is not positive."""
    top = F.max(by).over(Window.partitionBy("query_id"))
    if floor <= 0:
        return hits
    return hits.withColumn("__top", top).filter((F.col("__top") <= 0) | (F.col(by) >= F.col("__top") * floor)).drop("__top")


def absolute_floor(hits: DataFrame, least: float, by: str = "evidence") -> DataFrame:
    """All hits of a query whose best reaches ``least``, none of others."""
    if least <= 0:
        return hits
    return hits.withColumn("__top", F.max(by).over(Window.partitionBy("query_id"))).filter(F.col("__top") >= least).drop("__top")


def diversify(hits: DataFrame, limit: int, path: str = "file_path") -> DataFrame:
    """Best hit of each path in order of ``position``; documents fill at most half while sources are there."""
    key = trimmed(F.col(path))
    per_path = Window.partitionBy("query_id", key).orderBy("position")
    unique = hits.withColumn("__nth", F.row_number().over(per_path)).filter("__nth = 1")
    is_doc = path_class(F.col(path)) == "doc"
    unique = unique.withColumns({"__doc": is_doc, "__sources": F.max((~is_doc).cast("int")).over(Window.partitionBy("query_id"))})
    nth_doc = F.row_number().over(Window.partitionBy("query_id", "__doc").orderBy("position"))
    unique = unique.withColumn("__late", (F.col("__doc") & (F.col("__sources") == 1) & (nth_doc > doc_slots(limit))).cast("int"))
    order = Window.partitionBy("query_id").orderBy("__late", "position")
    placed = unique.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= limit)
    return placed.withColumn("position", F.col("__place")).drop("__nth", "__doc", "__sources", "__late", "__place")


def reorder(hits: DataFrame, ranks: DataFrame, head: int = SETTINGS.rerank_head) -> DataFrame:
    """Hits of the head that a reranker named come first, in its order; scores stay."""
    first = ranks.groupBy("query_id", "id").agg(F.min("rerank").alias("rerank"))
    joined = hits.join(first, ["query_id", "id"], "left")
    in_head = F.col("position") <= head
    order = Window.partitionBy("query_id").orderBy(
        F.when(in_head & F.col("rerank").isNotNull(), 0).when(in_head, 1).otherwise(2), F.when(in_head, F.coalesce("rerank", F.lit(1 << 30))), "position"
    )
    return joined.withColumn("position", F.row_number().over(order)).drop("rerank")


def rerank_results(head: DataFrame, results: DataFrame) -> DataFrame:
    """Ranks (query_id, id, rerank) from a reranker's answers (query_id, seq, index, score) on the ``head``.

    ``index`` counts the head's hits from 0 by position. Answers whose index is
    no whole number within the head, or whose score is not finite, are left
    out; of several for a hit the first counts; the rest go by score.
    """
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("position")) - 1
    places = head.select("query_id", "id", nth.cast("double").alias("index"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    sound = results.filter(finite).select("query_id", "seq", F.col("index").cast("double").alias("index"), "score").join(places, ["query_id", "index"])
    first = sound.groupBy("query_id", "id").agg(F.min("seq").alias("seq"), F.min_by("score", "seq").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return first.select("query_id", "id", F.row_number().over(order).alias("rerank"))


def reranked(hits: DataFrame, ask, head: int = SETTINGS.rerank_head) -> DataFrame:
    """Hits in the order of a reranker; ``ask`` maps the head's rows to answers (query_id, seq, index, score).

    A query without answers (the reranker failed or was late) keeps its order.
    """
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    placed = hits.withColumn("position", nth)
    first = placed.filter(F.col("position") <= head)
    return reorder(placed, rerank_results(first, ask(first)), head)


def dot(a: str, b: str, size: int) -> Column:
    """Inner product written out, which stays in generated code."""
    total = F.col(a)[0] * F.col(b)[0]
    for k in range(1, size):
        total = total + F.col(a)[k] * F.col(b)[k]
    return total
