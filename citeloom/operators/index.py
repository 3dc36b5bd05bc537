"""A stored index of chunks in blocks of documents: dense vectors and sparse postings side by side.

``encode`` gives each chunk its vector and its term weights, ``pack`` puts what a
task holds in blocks, and ``nearest`` reads every block once for all stated
queries. A block is a small index of its own: the vectors as one matrix, and for
each term the places and weights of its documents and the largest weight. Nothing
is shuffled but the best few of each query from each task. The best so far are
kept while a task reads its blocks, and a block whose largest weights cannot reach
a query's worst kept score is skipped for that query.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citeloom.config import SETTINGS
from citeloom.functions.text import BAG_TOKEN, TOKEN
from citeloom.session import keep

Embed = Callable[[list[str]], list]
ENCODER = "bm25-identifiers-1"  # stamp of the sparse encoding
EMBED_BATCH = 32
BLOCK = 2048  # chunks of a block
GROUP = 4  # blocks that a reader holds at once, whatever they compress to
QUERIES = 1024  # queries that one reading of the blocks answers
NEAR = 2e-6  # scores are rounded to six places later, so ties are kept this far apart

_TOKEN, _BAG = re.compile(TOKEN), re.compile(BAG_TOKEN)
_CAMEL, _ACRONYM = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])")


@lru_cache(maxsize=1 << 18)
def _parts(raw: str) -> tuple[str, ...]:
    """Terms of an identifier, as ``functions.text.split_identifier`` gives them."""
    parts = [raw, *(c for p in raw.split("_") for c in _ACRONYM.sub(r"\1 \2", _CAMEL.sub(r"\1 \2", p)).split(" "))]
    return tuple(dict.fromkeys(p.lower() for p in parts if len(p) >= 2))


def terms(text: str) -> Counter:
    """Term frequencies of a text."""
    found: Counter = Counter()
    for raw, n in Counter(_TOKEN.findall(text)).items():
        for term in _parts(raw):
            found[term] += n
    return found


@lru_cache(maxsize=1 << 18)
def _dimension(token: str) -> int:
    return int(hashlib.sha256(token.encode()).hexdigest()[:8], 16) % SETTINGS.vector_size


def bag(texts: list[str]) -> np.ndarray:
    """The default embedder: ``functions.text.bag_vector`` of each text."""
    out = np.zeros((len(texts), SETTINGS.vector_size))
    for row, text in zip(out, texts):
        np.add.at(row, [_dimension(t) for t in _BAG.findall(text.lower())], 1.0)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms == 0, 1.0, norms)


def embedded(texts: list[str], embed: Embed) -> list[np.ndarray]:
    """Vectors of texts, asked for in batches; a wrong count, an empty vector or a number that is not finite is refused."""
    out = []
    for low in range(0, len(texts), EMBED_BATCH):
        asked = texts[low : low + EMBED_BATCH]
        vectors = embed(asked)
        if len(vectors) != len(asked):
            raise ValueError(f"{len(asked)} texts were embedded as {len(vectors)} vectors")
        for vector in vectors:
            vector = np.asarray(vector, dtype=np.float64)
            if vector.ndim != 1 or not vector.size or not np.isfinite(vector).all():
                raise ValueError("an embedded vector is empty or not finite")
            out.append(vector)
    return out


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _slim(chunks: DataFrame, content: str) -> tuple[DataFrame, list[str]]:
    scope = [c for c in ("repo_id",) if c in chunks.columns]
    return chunks.select("id", *scope, F.coalesce(F.col(content).cast("string"), F.lit("")).alias("body")), scope


def _encoding(scope: list[str], embed: Embed) -> Batches:
    k1, b, mean = SETTINGS.bm25_k1, SETTINGS.bm25_b, SETTINGS.bm25_avgdl

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").to_pylist()
            vectors = embedded(texts, embed)
            named, weights = [], []
            for counts in map(terms, texts):
                tf = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
                named.append(list(counts))
                weights.append(tf * (k1 + 1) / (tf + k1 * (1 - b + b * max(tf.sum(), 1.0) / mean)))
            made = [pa.array(vectors, pa.list_(pa.float64())), pa.array(named, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", *scope)] + made, names=["id", *scope, "vector", "terms", "weights"])

    return each


def encode(chunks: DataFrame, embed: Embed = bag, content: str = "content") -> DataFrame:
    """``id`` (and ``repo_id``) with ``vector``, and ``terms`` with their ``weights``, of every chunk."""
    slim, scope = _slim(chunks, content)
    kept = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("id", *scope))
    return slim.mapInArrow(_encoding(scope, embed), f"{kept}, vector array<double>, terms array<string>, weights array<double>")


def _packing(scope: list[str], block: int) -> Batches:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, block):
                batch = whole.slice(low, block)
                lengths = np.diff(batch.column("vector").offsets.to_numpy())
                if (lengths != lengths[0]).any():
                    raise ValueError("vectors of one block have several lengths")
                matrix = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                weights = batch.column("weights")
                sizes = np.diff(weights.offsets.to_numpy())
                owners = np.repeat(np.arange(batch.num_rows, dtype=np.int32), sizes)
                coded = batch.column("terms").flatten().dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                flat = weights.flatten().to_numpy()[order]
                counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
                most = np.maximum.reduceat(flat, starts) if len(flat) else np.zeros(0)
                row = {
                    "ids": [batch.column("id").to_pylist()], **{c: [batch.column(c).to_pylist()] for c in scope}, "width": [matrix.shape[1]], "matrix": [matrix.tobytes()],
                    "terms": [coded.dictionary.to_pylist()], "counts": [counts.tolist()], "most": [most.tolist()], "owners": [owners[order].tobytes()], "weights": [flat.tobytes()],
                }
                kinds = {c: pa.list_(batch.schema.field(c).type) for c in scope} | {
                    "ids": pa.list_(batch.schema.field("id").type), "width": pa.int32(), "matrix": pa.binary(), "terms": pa.list_(pa.string()), "counts": pa.list_(pa.int32()),
                    "most": pa.list_(pa.float64()), "owners": pa.binary(), "weights": pa.binary(),
                }
                yield pa.RecordBatch.from_pydict(row, pa.schema([(k, kinds[k]) for k in row]))

    return each


def _packed_schema(rows: DataFrame, scope: list[str]) -> str:
    types = {c: rows.schema[c].dataType.simpleString() for c in ("id", *scope)}
    own = "".join(f", {c} array<{types[c]}>" for c in scope)
    return f"ids array<{types['id']}>{own}, width int, matrix binary, terms array<string>, counts array<int>, most array<double>, owners binary, weights binary"


def pack(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``encode`` in blocks, where they lie: ids, the matrix, and postings by term."""
    scope = [c for c in ("repo_id",) if c in points.columns]
    return points.mapInArrow(_packing(scope, block), _packed_schema(points, scope))


def build(chunks: DataFrame, embed: Embed = bag, content: str = "content") -> DataFrame:
    """The packed index of chunks, written once to the shared folder and read from there.

    Chunks are dealt by id first: one file may hold most of them, and reading and
    embedding a text costs more than sending it. One worker a task encodes and
    packs them, so vectors and terms do not travel between two.
    """
    slim, scope = _slim(chunks.repartition("id"), content)
    encoded, packed = _encoding(scope, embed), _packing(scope, BLOCK)
    return keep(slim.mapInArrow(lambda batches: packed(encoded(batches)), _packed_schema(slim, scope)), GROUP)


def _asked(index: DataFrame, queries: list, embed: Embed) -> list[dict]:
    """Queries with their vectors and, for each term that the index holds, frequency times idf."""
    vectors = [np.asarray(q["vector"]) for q in queries] if queries and "vector" in queries[0] else embedded([q["query"] or "" for q in queries], embed)
    wanted = [terms(q["query"] or "") for q in queries]
    names = pa.array(sorted({t for w in wanted for t in w}), pa.string())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = batch.column("terms").flatten(), batch.column("counts").flatten()
            mine = pa.compute.is_in(found, names)
            sizes = pa.array([batch.column("size").to_numpy().sum()], pa.int64())
            yield pa.RecordBatch.from_arrays([found.filter(mine), counts.filter(mine).cast(pa.int64())], names=["term", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), sizes], names=["term", "n"])

    slim = index.select("terms", "counts", F.size("ids").alias("size")).mapInArrow(each, "term string, n long")
    df = {r["term"]: r["n"] for r in slim.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # of asked terms alone; null counts the chunks
    total = df.pop(None, 0)
    idf = {t: float(np.log(1 + (total - n + 0.5) / (n + 0.5))) for t, n in df.items()}
    return [{"query_id": q["query_id"], "repo": q.get("repo_id"), "vector": v, "terms": {t: n * idf[t] for t, n in w.items() if t in idf}} for q, v, w in zip(queries, vectors, wanted)]


class _Best:
    """The best of each query that a task has met, and the score that a newcomer must reach."""

    def __init__(self, queries: int, limit: int) -> None:
        self.limit, self.held, self.least = limit, [[] for _ in range(queries)], np.full(queries, -np.inf)

    def add(self, q: int, ids: list, scores: np.ndarray) -> None:
        """Hits of a block that can be among the best; what falls out is let go of now and then."""
        if len(scores) > self.limit:
            floor = np.partition(scores, -self.limit)[-self.limit] - NEAR
            at = np.flatnonzero(scores >= floor)
        else:
            at = np.arange(len(scores))
        at = at[scores[at] >= self.least[q] - NEAR]
        held = self.held[q]
        held += [(float(scores[k]), ids[k]) for k in at.tolist()]
        if len(held) >= self.limit:
            all_ = np.array([s for s, _ in held])
            self.least[q] = np.partition(all_, -self.limit)[-self.limit]
            if len(held) > 4 * self.limit:
                self.held[q] = [h for h in held if h[0] >= self.least[q] - NEAR]

    def rows(self) -> Iterator[tuple[int, float, object]]:
        for q, held in enumerate(self.held):
            for score, id_ in held:
                if score >= self.least[q] - NEAR:
                    yield q, score, id_


def _block(row: dict, queries: list[dict], matrix: np.ndarray, scoped: bool, floor: float, best: dict[str, _Best], channels: tuple[str, ...]) -> tuple[int, int]:
    """Scores of all queries in one block; how many (query, block) pairs of the sparse channel there were, and were skipped."""
    ids, repos = row["ids"], row.get("repo_id")
    mine = {r: np.flatnonzero([x == r for x in repos]) for r in {q["repo"] for q in queries}} if scoped else {}
    if "dense" in channels:
        vectors = np.frombuffer(row["matrix"]).reshape(len(ids), row["width"])
        if matrix.shape[1] != row["width"]:
            raise ValueError(f"queries have {matrix.shape[1]} dimensions, stored vectors {row['width']}")
        scores = vectors @ matrix.T
        for q, query in enumerate(queries):
            own = mine[query["repo"]] if scoped else np.arange(len(ids))
            column = scores[own, q]
            good = column >= floor - NEAR
            if good.any():
                best["dense"].add(q, [ids[k] for k in own[good].tolist()], column[good])
    if "sparse" not in channels:
        return 0, 0
    place = {t: k for k, t in enumerate(row["terms"])}
    starts = np.concatenate([[0], np.cumsum(row["counts"])])
    owners, weights = np.frombuffer(row["owners"], dtype=np.int32), np.frombuffer(row["weights"])
    skipped = 0
    for q, query in enumerate(queries):
        here = [(place[t], w) for t, w in query["terms"].items() if t in place]
        if not here or sum(w * row["most"][k] for k, w in here) < best["sparse"].least[q] - NEAR:
            skipped += 1
            continue
        scores = np.zeros(len(ids))
        for k, w in here:
            part = slice(starts[k], starts[k + 1])
            scores[owners[part]] += w * weights[part]  # a document comes once a term
        hit = scores > 0
        if scoped:
            only = np.zeros(len(ids), dtype=bool)
            only[mine[query["repo"]]] = True
            hit &= only
        at = np.flatnonzero(hit)
        if len(at):
            best["sparse"].add(q, [ids[k] for k in at.tolist()], scores[at])
    return len(queries), skipped


def nearest(index: DataFrame, queries: DataFrame, limit: int, floor: float, embed: Embed = bag, channels: tuple[str, ...] = ("dense", "sparse")) -> DataFrame:
    """(query_id, id, channel, score) of what can be among the ``limit`` best of each query and channel.

    ``queries`` has query_id, query, ``repo_id`` where the index holds several
    repositories, and may bring its own ``vector``. Dense scores are inner
    products of at least ``floor``; sparse ones sum frequency, idf and weight of
    shared terms. Queries are read to the driver, as they are stated by a user,
    and answered ``QUERIES`` at a time.
    """
    scoped = "repo_id" in index.columns
    if scoped and "repo_id" not in queries.columns:
        raise ValueError("queries on rows of several repositories need a repo_id")
    stated = [r.asDict() for r in queries.collect()]
    key_type = to_arrow_type(queries.schema["query_id"].dataType)
    id_type, key = index.schema["ids"].dataType.elementType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {key}, id {id_type}, channel string, score double"
    found = index.sparkSession.createDataFrame([], schema)
    for low in range(0, len(stated), QUERIES):
        asked = _asked(index, stated[low : low + QUERIES], embed)
        found = found.unionByName(_read(index, asked, scoped, limit, floor, channels, schema, key_type))
    return found


def _read(index: DataFrame, asked: list[dict], scoped: bool, limit: int, floor: float, channels: tuple[str, ...], schema: str, key_type: pa.DataType) -> DataFrame:
    def each(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {c: _Best(len(asked), limit) for c in channels}
        matrix = np.array([q["vector"] for q in asked])
        id_type = None
        for batch in frames:
            id_type = batch.schema.field("ids").type.value_type
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                _block(row, asked, matrix, scoped, floor, best, channels)
        rows = [(asked[q]["query_id"], id_, c, score) for c in channels for q, score, id_ in best[c].rows()]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), pa.array(columns[1], id_type), pa.array(columns[2]), pa.array(columns[3], pa.float64())], names=["query_id", "id", "channel", "score"])

    return index.mapInArrow(each, schema)


def skipped(index: DataFrame, queries: DataFrame, limit: int, embed: Embed = bag) -> DataFrame:
    """(pairs, skipped): how many pairs of a query and a block there are, and how many need no reading of postings."""
    asked = _asked(index, [r.asDict() for r in queries.collect()], embed)
    scoped = "repo_id" in index.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, matrix, counts = {"sparse": _Best(len(asked), limit)}, np.zeros((len(asked), 1)), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                counts += _block(batch.slice(k, 1).to_pylist()[0], asked, matrix, scoped, 0.0, best, ("sparse",))
        yield pa.RecordBatch.from_arrays([pa.array([counts[0]]), pa.array([counts[1]])], names=["pairs", "skipped"])

    return index.mapInArrow(each, "pairs long, skipped long").agg(F.sum("pairs").alias("pairs"), F.sum("skipped").alias("skipped"))


GRAM = 3


def lexical_candidates(chunks: DataFrame, asked: DataFrame, scope: list[str]) -> DataFrame:
    """(query_id, q, id, file_path, symbol) of chunks whose path or symbol holds ``q``, whatever the case.

    A text that holds ``q`` holds each of its runs of up to three characters. The
    run of ``q`` that the fewest chunks hold is joined with the runs of every
    path and symbol, and what that leaves is verified; no query meets all chunks.
    """
    low = F.lower("q")
    size = F.least(F.length("q"), F.lit(GRAM))
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda k: F.substring(c, k, n))
    named = asked.filter("q <> ''").withColumn("gram", F.explode(F.array_distinct(runs(low, size))))
    wanted = named.select("gram").distinct()
    texts = F.concat_ws("\0", F.lower(F.coalesce("file_path", F.lit(""))), F.lower(F.coalesce("symbol", F.lit(""))))
    every = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, GRAM + 1)]), lambda n: runs(F.col("texts"), n))))
    held = chunks.select("id", *scope, "file_path", "symbol", texts.alias("texts")).withColumn("gram", F.explode(every)).join(wanted, "gram", "left_semi").drop("texts")
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    # A run that no chunk holds counts 0, so a query with one finds nothing.
    rarest = named.join(df, "gram", "left").groupBy("query_id", *scope, "q").agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), F.col("gram"))).alias("gram"))
    found = held.join(rarest, ["gram", *scope])
    return found.filter(F.contains(F.lower("symbol"), low) | F.contains(F.lower("file_path"), low)).select("query_id", *scope, "q", "id", "file_path", "symbol")
