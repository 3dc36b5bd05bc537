"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1 and turned to their principal axes; the grid on
the leading ones, of the width of the greatest distance that still links, puts
them in one sequence. The sequence is cut in blocks, and the join goes down
pairs of its intervals: two intervals whose boxes are farther apart than that
distance are skipped, provably, with all they hold. What remains is joined
block by block, where smaller intervals are skipped alike, by matrix products.

Copies are joined once and carry their number. Within a pair of blocks links are
summed and chained at once, so a dense group yields no more rows than members.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of another size than the most common link
with their copies only; repeated rows are copies; an empty table gives an empty
result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import materialize
from citeloom.llm.components import components
from citeloom.llm.vectors import cosine, matrix, unit, usable

BLOCK = 4096
FINE = 256  # intervals within a block
GRID = 6  # leading axes that order the sequence
BOX = 12  # leading axes of the boxes of blocks
FAN = 8


def principal_axes(rows: DataFrame, size: int) -> np.ndarray:
    """Axes by falling variance, from second moments summed over all rows: size * size numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                u = unit(matrix(batch.column(0)))
                total += u.T @ u
        i, j = np.divmod(np.arange(size * size), size)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = rows.select("embedding").mapInArrow(each, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    moments = np.zeros((size, size))
    for r in sums:
        moments[r["i"], r["j"]] = r["s"]
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


def sequence(distinct: DataFrame, axes: np.ndarray, epsilon: float, partitions: int) -> DataFrame:
    """``distinct`` (vid, copies, embedding) in grid order, cut in blocks: adds ``block``."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = unit(matrix(batch.column(2))) @ axes[:, :GRID]
                grid = np.floor(y / epsilon).astype(np.int32)
                fine = pa.array(y[:, 0])
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(grid[:, k]) for k in range(grid.shape[1])], fine], names=[*batch.schema.names, *keys, "y"])

    keys = [f"c{k}" for k in range(min(GRID, axes.shape[1]))]
    gridded = distinct.mapInArrow(cells, "vid long, copies long, embedding array<float>, " + ", ".join(f"{k} int" for k in keys) + ", y double")
    order = [*keys, "y", "vid"]
    placed = gridded.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = materialize(placed.select("vid", "copies", "embedding", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    counts = placed.groupBy(part.alias("p")).count()  # one row for each partition
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("p", part).join(base, "p").select("vid", "copies", "embedding", rank.alias("rank"), F.floor(rank / BLOCK).alias("block"))


def _gap(a: str, b: str, dims: int) -> Column:
    """Squared distance of two boxes."""
    total = F.lit(0.0)
    for k in range(dims):
        apart = F.greatest(F.col(f"{b}.lo")[k] - F.col(f"{a}.hi")[k], F.col(f"{a}.lo")[k] - F.col(f"{b}.hi")[k], F.lit(0.0))
        total = total + apart * apart
    return total


def block_pairs(boxes: DataFrame, blocks: int, dims: int, epsilon: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose boxes are near enough, going down a tree of intervals."""
    levels = [boxes.select(F.col("block").alias("node"), "lo", "hi")]
    width = blocks
    while width > 1:
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(
            F.array(*[F.min(F.col("lo")[k]) for k in range(dims)]).alias("lo"), F.array(*[F.max(F.col("hi")[k]) for k in range(dims)]).alias("hi")
        )
        levels.append(up)
        width = -(-width // FAN)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        child = lambda x: level.select(F.floor(F.col("node") / FAN).alias(x), F.struct("node", "lo", "hi").alias(f"{x}_"))  # noqa: E731,B023
        grown = pairs.join(child("a"), "a").join(child("b"), "b").filter("a_.node <= b_.node")
        near = grown.filter(_gap("a_", "b_", dims) <= epsilon * epsilon * (1 + 1e-9))
        pairs = materialize(near.select(F.col("a_.node").alias("a"), F.col("b_.node").alias("b")))
    return pairs


def _chained(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least of n numbers that each reaches by the links (x, y)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if np.array_equal(before, label):
            return label


def _join_pair(a: dict, b: dict, same: bool, least: float, epsilon: float, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, links counted with copies, and the least row that links within the pair reach."""
    rows = unit(a["v"]) if same else np.concatenate([unit(a["v"]), unit(b["v"])])
    raw = a["v"] if same else np.concatenate([a["v"], b["v"]])
    vid = a["vid"] if same else np.concatenate([a["vid"], b["vid"]])
    copies = a["copies"] if same else np.concatenate([a["copies"], b["copies"]])
    n, split = len(rows), len(a["v"])
    turned = rows @ axes
    cuts = np.unique(np.concatenate([np.arange(0, n, FINE), [split, n]]))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    low = np.array([turned[s:e].min(axis=0) for s, e in spans])
    high = np.array([turned[s:e].max(axis=0) for s, e in spans])
    links, label = np.zeros(n), np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, (s, e) in enumerate(spans):
        gap = np.maximum(np.maximum(low - high[i], low[i] - high), 0)
        for j in np.flatnonzero((gap * gap).sum(axis=1) <= epsilon * epsilon * (1 + 1e-9)).tolist():
            if j < i or not same and (s < split) == (spans[j][0] < split):
                continue
            t, f = spans[j]
            near = rows[s:e] @ rows[t:f].T
            hit = near >= least
            edge = np.argwhere(np.abs(near - least) < 1e-9)
            if len(edge):
                hit[edge[:, 0], edge[:, 1]] = cosine(raw[s + edge[:, 0]], raw[t + edge[:, 1]]) >= least
            if i == j:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links[s:e] += hit @ copies[t:f]
            if i != j:
                links[t:f] += hit.T @ copies[s:e]
            # A tile's links are chained at once: it leaves a pair a row it touches, not a pair a link.
            x, y = np.nonzero(hit)
            least_of = _chained(n, x + s, y + t)
            touched = np.flatnonzero(least_of != np.arange(n))
            found.append((touched, least_of[touched]))
    if found:
        label = _chained(n, *(np.concatenate(side) for side in zip(*found)))
    return vid, links.astype(np.int64), vid[label]


def group(embeddings: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = embeddings.sparkSession
    epsilon = (2 - 2 * least) ** 0.5
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    good = usable("embedding")
    distinct = materialize(rows.filter(good).groupBy("embedding").agg(F.min("id").alias("vid"), F.count("*").alias("copies")).select("vid", "copies", "embedding"))
    sizes = distinct.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    alone = rows.filter(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if sizes is None:
        return _named(alone, id_col)
    size, number = sizes["n"], sizes["count"]
    joinable = distinct.filter(F.size("embedding") == size)
    axes, blocks = principal_axes(joinable, size), -(-number // BLOCK)
    ordered = sequence(joinable, axes, epsilon, max(1, blocks))
    dims = min(BOX, size)

    def assemble(block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        y = unit(matrix(block.column("embedding"))) @ axes[:, :dims]
        packed = [block.column(c).to_numpy().astype("<i8").tobytes() for c in ("vid", "copies")]
        packed.append(matrix(block.column("embedding"), np.float32).tobytes())
        return pa.table({
            "block": [block.column("block")[0].as_py()], "vids": [packed[0]], "copies": [packed[1]], "rows": [packed[2]],
            "lo": [y.min(axis=0).tolist()], "hi": [y.max(axis=0).tolist()],
        })

    built = ordered.groupBy("block").applyInArrow(assemble, "block long, vids binary, copies binary, rows binary, lo array<double>, hi array<double>")
    built = materialize(built)
    pairs = block_pairs(built.select("block", "lo", "hi"), blocks, dims, epsilon)
    side = lambda x: built.select(F.col("block").alias(x), F.struct("vids", "copies", "rows").alias(f"{x}_"))
    tasks = pairs.repartition(max(1, -(-pairs.count() // 16)), "a", "b")
    tasks = tasks.join(side("a"), "a").join(side("b"), "b")
    shared = spark.sparkContext.broadcast(axes)  # size * size numbers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda s: {"vid": np.frombuffer(s["vids"], "<i8"), "copies": np.frombuffer(s["copies"], "<i8"), "v": np.frombuffer(s["rows"], "<f4").reshape(-1, size).astype(np.float64)}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("a", "b", "a_", "b_")}
                vid, links, root = _join_pair(read(r["a_"]), read(r["b_"]), r["a"] == r["b"], least, epsilon, shared.value)
                told = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(vid[told]), pa.array(links[told]), pa.array(root[told])], names=["vid", "links", "root"])

    found = materialize(tasks.mapInArrow(each, "vid long, links long, root long"))
    roots = components(found.select(F.col("vid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vid")
    counted = found.groupBy("vid").agg(F.sum("links").alias("links"))
    known = distinct.join(counted, "vid", "left").join(roots, "vid", "left")
    known = known.select("vid", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "vid").alias("root"))
    known = materialize(known)
    smallest = known.groupBy("root").agg(F.min("vid").alias("component_id"))
    known = known.join(smallest, "root").select("embedding", "n_links", "component_id")
    linked = rows.filter(good).join(known, "embedding").select("id", "n_links", "component_id")
    return _named(linked.unionByName(alone), id_col)


def _named(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
