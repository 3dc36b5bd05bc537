"""Approximate nearest neighbours by learned partitions.

On a sample of at most ``SAMPLE`` vectors a neighbour graph is built and cut in
parts of equal size that keep neighbours together; a small classifier learns
each vector's part. It then deals every vector of the table to its most probable
part, and routes each query to several; how many is set so that sampled queries
find ``TARGET`` of their neighbours. Routed candidates are all reranked by exact
cosine. Large parts, and the queries that reach them, are dealt in blocks, so no
group grows with the table; there are at most ``SAMPLE / 64`` parts, so the work
of a query does. A table of up to ``PART`` vectors is one part.

Copies are searched once: a distinct vector carries its least ids, as many as an
answer can hold. Defined results: vectors that are null, empty, zero or hold
null or non-finite components take no part, nor do vectors of another size than
the most common; equal scores go to the smaller id; fewer candidates give fewer
rows; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize
from citeloom.llm.vectors import cosine, matrix, unit, usable

SAMPLE = 8192  # vectors that the index is fitted on, at most
PART = 2048  # vectors meant for a part
BLOCK = 2048  # vectors of a part, and queries, compared in one group
CLOSE = 1e-9  # products of unit vectors this near to the last one kept are told apart by the exact cosine
DEGREE = 10  # neighbours of a vector in the graph
TARGET = 0.97


def neighbour_graph(u: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` nearest other rows of each row, by cosine."""
    out = np.empty((len(u), k), dtype=np.int64)
    v = u.astype(np.float32)
    for s in range(0, len(u), 512):
        near = v[s : s + 512] @ v.T
        near[np.arange(len(near)), s + np.arange(len(near))] = -2
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        out[s : s + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1), axis=1)
    return out


def balanced_parts(u: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each row: equal sizes, few graph edges cut.

    Starts from halving along principal directions; then rows move to the part
    of most of their neighbours, in order of gain, while parts stay in bounds.
    """
    label = np.zeros(len(u), dtype=np.int64)
    todo = [(np.arange(len(u)), 0, parts)]
    while todo:
        rows, first, number = todo.pop()
        if number == 1:
            label[rows] = first
            continue
        half = number // 2
        x = u[rows] - u[rows].mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        order = rows[np.argsort(along, kind="stable")]
        cut = len(rows) * half // number
        todo += [(order[:cut], first, half), (order[cut:], first + half, number - half)]
    least, most = int(0.85 * len(u) / parts), int(1.15 * len(u) / parts) + 1
    for _ in range(rounds):
        votes = np.zeros((len(u), parts), dtype=np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(u)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        wish = votes.argmax(axis=1)
        gain = votes.max(axis=1) - votes[np.arange(len(u)), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            a, b = label[i], wish[i]
            if sizes[a] > least and sizes[b] < most:
                sizes[a] -= 1
                sizes[b] += 1
                label[i] = b
                moved += 1
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Router:
    """Classifier of one hidden layer: vectors to log-odds of parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, u: np.ndarray) -> np.ndarray:
        return np.maximum(u.astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def route(self, u: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each row, best first."""
        return np.argsort(-self.logits(u), axis=1, kind="stable")[:, :probes]


def fit(vectors: np.ndarray, total: int) -> Router:
    """Fit parts and classifier on sampled vectors for a table of ``total``."""
    size = vectors.shape[1] if vectors.ndim == 2 else 0
    rng = np.random.default_rng(0)
    parts = max(1, min(-(-total // PART), len(vectors) // 64))
    hidden = 96
    w1 = rng.normal(0, (2 / max(size, 1)) ** 0.5, (size, hidden)).astype(np.float32) * np.float32(size**0.5)
    w2 = np.zeros((hidden, parts), dtype=np.float32)
    b1, b2 = np.zeros(hidden, dtype=np.float32), np.zeros(parts, dtype=np.float32)
    if parts == 1:
        return Router(w1, b1, w2, b2, 1)
    u = unit(vectors).astype(np.float32)
    graph = neighbour_graph(u, min(DEGREE, len(u) - 1))
    label = balanced_parts(u.astype(np.float64), graph, parts)
    weights = [w1, b1, w2, b2]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, batch = 0, 256
    for epoch in range(25):
        order = rng.permutation(len(u))
        for s in range(0, len(u), batch):
            x, y = u[order[s : s + batch]], label[order[s : s + batch]]
            h = np.maximum(x @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ weights[2].T) * (h > 0)
            step += 1
            rate = 0.005 * 0.9**epoch * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for w, m, v, g in zip(weights, first, second, (x.T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * m / (np.sqrt(v) + 1e-8)
    # Probes: as few as find TARGET of the sampled rows' five nearest.
    router = Router(*weights, probes=1)
    ranked = router.route(u, parts)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.broadcast_to(np.arange(parts), ranked.shape), axis=1)
    dealt = ranked[:, 0]
    needed = np.take_along_axis(place, dealt[graph[:, :5]], axis=1)
    probes = int(np.quantile(needed, TARGET, method="higher")) + 1
    return Router(*weights, probes=min(parts, max(probes, min(parts, 2))))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(embedding, ids): distinct vectors with their least ``keep`` ids, combined before the shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            m = matrix(batch.column(1), np.float32) + np.float32(0)  # -0.0 becomes 0.0
            if not len(m):
                continue
            _, group = np.unique(np.ascontiguousarray(m).view(f"V{m.shape[1] * 4}").ravel(), return_inverse=True)
            order = np.lexsort((ids, group))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1])
            ends = np.concatenate([starts[1:], [len(order)]])
            lists = [ids[order[s : min(e, s + keep)]].tolist() for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(order[starts])), pa.array(lists, pa.list_(pa.int64()))], names=["embedding", "ids"])

    combined = rows.select("id", "embedding").mapInArrow(each, "embedding array<float>, ids array<long>")
    ids = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep)
    return combined.groupBy("embedding").agg(ids.alias("ids"))


def search(embeddings: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row that ``queries`` selects."""
    spark = embeddings.sparkSession
    rows = embeddings.filter(F.col(id_col).isNotNull() & usable(vector_col))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"), queries.alias("asked"))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = sizes["n"] if sizes else 0
    rows = rows.filter(F.size("embedding") == size)
    distinct = materialize(_distinct(rows, k + 1).withColumn("vid", F.col("ids")[0]))
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("embedding").toArrow()
    router = fit(matrix(sample.column("embedding")), total)
    shared = spark.sparkContext.broadcast(router)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = shared.value.route(unit(matrix(batch.column(2))), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["vid", "ids", "embedding", "part"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = shared.value.route(unit(matrix(batch.column(1))), shared.value.probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.tolist(), pa.list_(pa.int32()))], names=["vid", "embedding", "parts"])

    indexed = materialize(distinct.select("vid", "ids", "embedding").mapInArrow(dealt, "vid long, ids array<long>, embedding array<float>, part int"))
    asked = rows.filter("asked").select("id", "embedding")
    wanted = asked.select("embedding").distinct().join(distinct.select("embedding", "vid"), "embedding").select("vid", "embedding")
    probes = wanted.mapInArrow(routed, "vid long, embedding array<float>, parts array<int>")
    probes = materialize(probes.select("vid", "embedding", F.explode("parts").alias("part")))
    number = lambda df, to: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(to))
    blocks = number(indexed, "blocks").join(number(probes, "asks"), "part")  # a row for each part, of which there are at most SAMPLE / 64
    salt = lambda n: F.pmod(F.xxhash64("vid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = indexed.join(F.broadcast(blocks), "part").select("part", salt("blocks").alias("salt"), every("asks").alias("ask"), "vid", "ids", "embedding")
    probes = probes.join(F.broadcast(blocks), "part").select("part", every("blocks").alias("salt"), salt("asks").alias("ask"), F.col("vid").alias("query"), "embedding")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "vid": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            q, c = matrix(left.column("embedding")), matrix(right.column("embedding"))
            qids, cids, lists = left.column("query").to_numpy(), right.column("vid").to_numpy(), right.column("ids").to_pylist()
            uq, uc = unit(q), unit(c)
            order = np.argsort(cids, kind="stable")
            c, uc, cids = c[order], uc[order], cids[order]
            keep = min(k + 1, len(c))
            for s in range(0, len(q), 512):
                near = uq[s : s + 512] @ uc.T
                cut = np.partition(near, len(c) - keep, axis=1)[:, len(c) - keep]
                which, at = np.nonzero(near >= cut[:, None] - CLOSE)
                which += s
                score = cosine(q[which], c[at])
                best = np.lexsort((cids[at], -score, which))
                which, at, score = which[best], at[best], score[best]
                first = np.searchsorted(which, which)
                kept = np.arange(len(which)) - first < keep
                out["query"] += qids[which[kept]].tolist()
                out["vid"] += cids[at[kept]].tolist()
                out["ids"] += [lists[order[i]] for i in at[kept].tolist()]
                out["score"] += score[kept].tolist()
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("vid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]))

    found = probes.groupBy("part", "salt", "ask").cogroup(candidates.groupBy("part", "salt", "ask")).applyInArrow(rerank, "query long, vid long, ids array<long>, score double")
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id")))
    best = found.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("best"))
    named = best.join(distinct.select(F.col("vid").alias("query"), "embedding"), "query").select("embedding", "best")
    answers = asked.join(named, "embedding").select("id", F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    return answers.select(F.col("id").alias("query_id"), F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.minus")).alias("score")
    )
