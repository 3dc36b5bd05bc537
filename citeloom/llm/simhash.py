"""SimHash near-duplicates found by covering locality-sensitive hashing.

Bits are given nonzero codes in F2^(radius+1); mask v keeps the bits whose code
has an odd inner product with v. The codes of at most ``radius`` differing bits
span a proper subspace, so some nonzero v is orthogonal to all of them, and its
mask hides every difference: each pair within the radius shares a masked value
in at least one table.

That guarantee costs 2^(radius+1) tables, and bits only estimate how many
shingles texts share. ``group_similar`` therefore decides by the exact Jaccard
similarity of the sets of shingles. Its candidates are near fingerprints and
sets that share one of the first hashes in a common order: of n hashes that must
agree in a share s, so many stand at the head that similar sets cannot miss
each other there.

Defined results: null and empty texts have fingerprint zero, linked like any
other; a text of fewer words than a shingle is one shingle; texts of any length
are read whole; equal texts share a fingerprint and are compared once; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import column_bytes, discard, materialize, sliced
from citeloom.llm.components import components

BITS = 64
BLOCK = 1024  # fingerprints compared at once
LATE = 4  # a hash in more of a sixteenth of the texts than this comes last in the order
LATE_MOST = 1 << 18  # late hashes sent to the tasks, the most frequent first
FEW = 128  # sets of a bucket that are paired one by one
BLOCK_BYTES, BLOCK_SETS = 1 << 18, 512  # bounds of what is compared at once with another such block
HOT = 2048  # a table's bucket beyond this is split by a third of its free bits
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text with A-Z lowered, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[s:e], 42) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype=np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """64-bit SimHash, as a signed integer: a bit is set if it is in more than half of the hashes."""
    if not len(found):
        return 0
    octets = found.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(found) > 256:
        votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS_OF for k in range(8)])
    else:
        votes = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(found), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp): the text's hash, and its fingerprint as a signed long."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            found = [hashes(t, shingle) for t in column_bytes(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(x) for x in found], pa.int64())], names=["id", "h", "fp"])

    id_type = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(each, f"id {id_type}, h long, fp long")


def masks(radius: int) -> list[int]:
    """The 2**(radius+1) - 1 masks, as signed longs."""
    codes = [1 + i % ((2 << radius) - 1) for i in range(BITS)]
    found = [sum(1 << i for i in range(BITS) if (codes[i] & v).bit_count() % 2) for v in range(1, 2 << radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def link_bucket(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least index that chains of near pairs within the bucket reach."""
    n = len(fps)
    label = np.arange(n)
    while True:
        new = label.copy()
        for i in range(0, n, BLOCK):
            for j in range(0, n, BLOCK):
                near = np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, j : j + BLOCK]) <= radius
                seen = np.where(near, label[None, j : j + BLOCK], n).min(axis=1)
                new[i : i + BLOCK] = np.minimum(new[i : i + BLOCK], seen)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links along the runs of equal (t, k) of a sorted partition: a tree per chain of near pairs."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []

    def flush(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(t)]]))
        two = starts[sizes == 2]
        if len(two):
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            if near.any():
                yield out(a[near], b[near])
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            run = fp[s : s + n]
            label = link_bucket(run, radius)
            moved = label != np.arange(n)
            if moved.any():
                yield out(run[moved], run[label[moved]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        t, k, fp = (np.concatenate(x) for x in zip(*held))
        same = (t == t[-1]) & (k == k[-1])
        last = len(t) - int(same[::-1].argmin()) if not same.all() else 0
        held = [(t[last:], k[last:], fp[last:])]
        if last:
            yield from flush(t[:last], k[:last], fp[:last].view(np.uint64))
    if held:
        t, k, fp = held[0]
        yield from flush(t, k, fp.view(np.uint64))


def near_pairs(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) links between distinct fingerprints: chains of near pairs, as trees.

    ``distinct`` has a long column ``fp`` without repeats. Buckets of more than
    HOT fingerprints are dealt again by each of ``radius + 1`` parts of the bits
    their mask hides, one of which no near pair differs in.
    """
    parts = radius + 1
    entries, sub = [], []
    for v, m in enumerate(masks(radius)):
        entries.append(F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")))
        hidden = [i for i in range(BITS) if not m >> i & 1]
        for p in range(parts):
            keep = sum(1 << i for i in hidden[p::parts]) | m & ((1 << BITS) - 1)
            sub.append((v, keep - (1 << BITS) if keep >> (BITS - 1) else keep))
    tables = len(entries)
    dealt = distinct.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.t", "e.k")
    full = materialize(_shared(dealt))
    finer = F.array(*[
        F.struct(F.lit(tables + n).alias("t"), F.col("fp").bitwiseAND(F.lit(keep)).alias("k"), F.lit(v).alias("v")) for n, (v, keep) in enumerate(sub)
    ])
    hot = full.filter(F.col("count") > HOT).select("fp", "t", F.filter(finer, lambda s: s["v"] == F.col("t")).alias("s"))
    hot = hot.select("fp", F.explode("s").alias("e")).select("fp", "e.t", "e.k")
    rows = full.filter(F.col("count") <= HOT).select("t", "k", "fp").unionByName(hot.select("t", "k", "fp"))
    return _linked(rows, radius)


def _shared(dealt: DataFrame) -> DataFrame:
    """Entries (t, k, fp) whose bucket holds more than one, with its ``count``."""
    return dealt.join(dealt.groupBy("t", "k").count().filter("count > 1"), ["t", "k"])


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    rows = rows.repartition("t", "k").sortWithinPartitions("t", "k", "fp")
    return rows.mapInArrow(lambda it: _links(it, radius), "a long, b long").distinct()


def group(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp, component_id): the least id that links of near fingerprints reach; no link within ``radius`` is lost."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col))
    firsts = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")))
    links = near_pairs(firsts.select("fp"), radius)
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(found, "fp").select(F.col("id").alias(id_col), "h", "fp", "component_id")


def _ordered(found: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Distinct hashes in one order for all texts: those of ``late`` (sorted) after the others."""
    own = np.unique(found)
    if not len(late):
        return own
    last = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
    return np.concatenate([own[~last], own[last]])


def _prefix(n: int, similarity: Fraction) -> int:
    """So many hashes at the head of n: texts at least so similar share one of them."""
    return n - -(-n * similarity.numerator // similarity.denominator) + 1 if n else 0


def late_hashes(docs: DataFrame, shingle: int, similarity: Fraction, text_col: str) -> np.ndarray:
    """Hashes of many texts, as a sixteenth of the texts tells; any choice is right, it only moves buckets.

    All shingles are counted, not heads alone: what takes the place of a late hash
    at a head must not be as frequent.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body", 4 << 20):
            found = [np.unique(hashes(text, shingle)) for text in column_bytes(batch, "body")]
            k, c = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["k", "c"])

    some = docs.select(body.alias("body")).distinct().filter(F.abs(F.xxhash64("body") % 16) == 0)
    often = some.mapInArrow(each, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).filter(F.col("c") > LATE)
    return np.sort(often.orderBy(F.desc("c"), "k").limit(LATE_MOST).toArrow().column("k").to_numpy().view(np.uint64))


def heads(docs: DataFrame, shingle: int, similarity: Fraction, id_col: str, text_col: str) -> DataFrame:
    """(id, h, fp, g, n, head): g tells the set of a text's n shingles; its head is shared by similar sets."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))
    late = docs.sparkSession.sparkContext.broadcast(late_hashes(docs, shingle, similarity, text_col))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            fp, g, n, head = [], [], [], []
            for text in column_bytes(batch, "body"):
                found = hashes(text, shingle)
                own = _ordered(found, late.value)
                fp.append(fingerprint(found))
                g.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                n.append(len(own))
                head.append(own[: _prefix(len(own), similarity)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(head, pa.list_(pa.int64()))],
                names=["id", "h", "fp", "g", "n", "head"],
            )

    id_type = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(each, f"id {id_type}, h long, fp long, g long, n long, head array<long>")


def _least_common(small, large, similarity: Fraction):
    """So many hashes the heads of similar sets of these sizes share at least: the rest of one cannot make up for fewer."""
    t, u = similarity.numerator, similarity.denominator
    up = lambda x, y: (x + y - 1 - (x + y - 1) % y) / y
    return up(t * (small + large), t + u) - up(t * large, u) + 1


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``a`` shares with each of ``b``, by products of incidence matrices of their common hashes."""
    of = lambda x: (np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x]))
    (ha, da), (hb, db) = of(a), of(b)
    common = np.intersect1d(ha, hb)
    out = np.zeros((len(a), len(b)), dtype=np.float32)

    def incidence(h: np.ndarray, d: np.ndarray, rows: int, some: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(some, h), len(some) - 1)
        hit = some[at] == h
        m = np.zeros((rows, len(some)), dtype=np.float32)
        m[d[hit], at[hit]] = 1
        return m

    for s in range(0, len(common), 4096):
        some = common[s : s + 4096]
        out += incidence(ha, da, len(a), some) @ incidence(hb, db, len(b), some).T
    return out.astype(np.int64)


def _block_links(x: list[dict], y: list[dict], similarity: Fraction) -> list[tuple[int, int]]:
    """A link for each two roots that similar sets of two blocks have."""
    (ga, ra, sa), (gb, rb, sb) = ((np.array([r["g"] for r in z]), np.array([r["root"] for r in z]), [np.frombuffer(r["own"], "<u8") for r in z]) for z in (x, y))
    both, size = _overlaps(sa, sb), lambda z: np.array([len(v) for v in z])
    alike = both * similarity.denominator >= similarity.numerator * (size(sa)[:, None] + size(sb)[None] - both)
    i, j = np.nonzero(alike & (ra[:, None] != rb[None]))
    _, first = np.unique(np.column_stack([ra[i], rb[j]]), axis=0, return_index=True)
    return list(zip(ga[i[first]].tolist(), gb[j[first]].tolist()))


def _own(texts: DataFrame, shingle: int) -> DataFrame:
    """(g, own): the sorted distinct hashes of each text of (g, body)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            own = [np.unique(hashes(t, shingle)).astype("<u8").tobytes() for t in column_bytes(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["g", "own"])

    return texts.select("g", "body").mapInArrow(each, "g long, own binary")


def crossing(buckets: DataFrame, roots: DataFrame, texts_of, told, shingle: int, similarity: Fraction) -> DataFrame:
    """(a, b): links between sets of different roots that meet in a bucket (k, n, g, count).

    Sets that meet in buckets of at most FEW sets are paired, if in as many as
    similar sets must; sets that meet in a larger one are compared in blocks. There
    sets that meet often have the same home, the hub of their fullest bucket, and
    lie in blocks of bounded size, of like sizes; two blocks that meet in as many
    buckets as similar sets must are compared whole, so no pair of sets is ever a
    row. Members that the hub's root has are kept in blocks of their own, which
    are not compared with each other.
    """
    rooted = buckets.join(roots.withColumnRenamed("node", "g"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    hubs = rooted.groupBy("k").agg(F.max_by(F.struct("g", "root"), F.struct("n", "g")).alias("hub"), (F.min("root") != F.max("root")).alias("mixed"))
    placed = materialize(rooted.join(hubs, "k"))
    mixed = placed.filter("mixed")
    few = mixed.filter(F.col("count") <= FEW).select("k", "g", "n", "root")
    other = few.select("k", F.col("g").alias("h"), F.col("n").alias("m"), F.col("root").alias("r"))
    t, u = similarity.numerator, similarity.denominator
    beside = few.join(other, "k").filter("(n < m OR n = m AND g < h) AND root <> r").filter(F.col("m") * t <= F.col("n") * u)
    beside = beside.groupBy("g", "n", "h", "m").count().filter(F.col("count") >= _least_common(F.col("n"), F.col("m"), similarity))
    near = told(beside.select(F.col("g").alias("a"), F.col("h").alias("b")))
    many = mixed.filter(F.col("count") > FEW)
    homes = many.groupBy("g").agg(F.max_by("hub", F.struct("count", "k")).alias("hub"), F.first("root").alias("root"), F.first("n").alias("n"))
    homes = homes.select("g", "n", "root", F.col("hub.g").alias("home"), (F.col("root") == F.col("hub.root")).alias("core"), F.floor(F.log("n") / F.log(F.lit(1.1))).alias("like"))
    homes = materialize(homes)
    sets = materialize(_own(texts_of(homes.select("g")), shingle).join(homes, "g"))
    key = ["home", "core", "like"]
    size = sets.groupBy(key).agg(F.ceil(F.greatest(F.sum(F.octet_length("own")) / BLOCK_BYTES, F.count("*") / BLOCK_SETS)).alias("blocks"))
    blocked = sets.join(size, key).withColumn("block", F.struct(*key, F.pmod(F.xxhash64("g"), "blocks").alias("salt")))
    packed = materialize(blocked.groupBy("block").agg(
        F.collect_list(F.struct("g", "root", "own")).alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"), F.first(F.when(F.col("core"), F.col("root"))).alias("only"),
    ))
    told = packed.select("block", F.struct("block", "least", "most", "only").alias("told"))
    where = materialize(blocked.select("g", "block").join(told, "block").select("g", "told"))
    met = mixed.select("k", "g", (F.col("count") > FEW).alias("large")).join(where, "g").select("k", "large", F.col("told").alias("a")).distinct()
    met = met.join(met.select("k", F.col("a").alias("b")), "k").filter(F.col("b.block") >= F.col("a.block")).select("a", "b", "large")
    alone = F.coalesce(F.col("a.only") == F.col("b.only"), F.lit(False))
    apart = (u * F.col("a.most") < t * F.col("b.least")) | (u * F.col("b.most") < t * F.col("a.least"))
    need = _least_common(F.least("a.least", "b.least"), F.greatest("a.most", "b.most"), similarity) - 2  # rounding may lift sizes between these by less
    pairs = met.filter(~alone & ~apart).groupBy("a", "b").agg(F.count("*").alias("count"), F.max("large").alias("large")).filter(F.col("large") & (F.col("count") >= need))
    pairs = materialize(pairs.select(F.col("a.block").alias("a"), F.col("b.block").alias("b")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _block_links(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), similarity)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    side = lambda name, to: packed.select(F.col("block").alias(name), F.col("sets").alias(to))
    far = materialize(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y").mapInArrow(each, "a long, b long"))
    discard(placed, homes, sets, packed, where, pairs)
    return near.unionByName(far)


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Those of the pairs (a, b) whose sets of shingles have the Jaccard similarity; ``texts`` has (g, body)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, None
            for x, y in zip(column_bytes(batch, "x"), column_bytes(batch, "y")):
                if x != last:
                    last, left = x, np.unique(hashes(x, shingle))
                right = np.unique(hashes(y, shingle))
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both * similarity.denominator >= similarity.numerator * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("g").alias("a"), F.col("body").alias("x")), "a").join(texts.select(F.col("g").alias("b"), F.col("body").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(each, "a long, b long")


def _likeliest(buckets: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b): for each set the neighbour by size and the hub that it meets in most of its buckets (k, n, g, count).

    A bucket's hub is the member whose buckets are fullest: in a group of copies
    with edits, one with few edits, which most of the others are similar to.
    """
    full = buckets.groupBy("g").agg(F.avg(F.log("count")).alias("full"))
    weighed = buckets.join(full, "g")
    in_order = Window.partitionBy("k").orderBy("n", "g")
    before = F.lag(F.struct("g", "n")).over(in_order)
    hubs = weighed.groupBy("k").agg(F.max_by(F.struct("g", "n"), F.struct("full", "g")).alias("b"))
    met = buckets.select("g", "n", before.alias("b"), F.lit(0).alias("way")).unionByName(buckets.join(hubs, "k").select("g", "n", "b", F.lit(1).alias("way")))
    met = met.filter(F.col("b")["g"] != F.col("g")).groupBy("g", "n", "b", "way").count()
    small, large = F.least("n", F.col("b")["n"]), F.greatest("n", F.col("b")["n"])
    met = met.filter((F.col("count") * 4 >= _least_common(small, large, similarity)) & (large * similarity.numerator <= small * similarity.denominator))
    return met.groupBy(F.col("g").alias("a"), "way").agg(F.max_by(F.col("b")["g"], F.struct("count", "b")).alias("b")).select("a", "b")


def group_similar(docs: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, component_id): the least id that links of texts with that Jaccard similarity of shingles reach.

    Near fingerprints (radius 2, covering) and each set's likeliest partners within
    buckets of equal head hashes are compared first; then all sets of a bucket that
    these links have not joined yet, block by block, so no link is lost.
    """
    prints = materialize(heads(docs, shingle, similarity, id_col, text_col))
    sets = materialize(prints.groupBy("g").agg(F.min(F.struct("id", "h")).alias("of"), F.min("id").alias("first"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("head").alias("head")))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))

    def texts_of(some: DataFrame) -> DataFrame:
        """(g, body) of the sets in ``some``; only their texts are read again."""
        wanted = sets.join(some, "g", "left_semi").select("g", "of")
        return hashed.join(wanted, hashed["id"].eqNullSafe(wanted["of"]["id"]) & (hashed["h"] == wanted["of"]["h"])).select("g", "body").dropDuplicates(["g"])

    def told(pairs: DataFrame) -> DataFrame:
        """Similar ones of the pairs."""
        pairs = materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        ends = pairs.select(F.col("a").alias("g")).union(pairs.select("b")).distinct()
        texts = materialize(texts_of(ends))
        found = materialize(similar(pairs, texts, shingle, similarity))
        discard(pairs, texts)
        return found

    keyed = sets.select(F.explode("head").alias("k"), "n", "g")
    buckets = materialize(keyed.join(keyed.groupBy("k").count().filter("count > 1"), "k"))
    beside = _likeliest(buckets, similarity)
    firsts = sets.groupBy("fp").agg(F.min("g").alias("g"))
    near = near_pairs(firsts.select("fp"), 2).join(firsts.select(F.col("fp").alias("a"), F.col("g").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("g").alias("y")), "b")
    links = told(beside.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    roots = materialize(components(links))
    links = links.unionByName(crossing(buckets, roots, texts_of, told, shingle, similarity))
    roots = components(links).withColumnRenamed("node", "g")
    rooted = sets.join(roots, "g", "left").select("g", "first", F.coalesce("root", "g").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(rooted.join(least, "root").select("g", "component_id"))
    return prints.join(found, "g").select(F.col("id").alias(id_col), "h", "component_id")


def first_of_each(docs: DataFrame, shingle: int = 5, similarity: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least id."""
    found = group_similar(docs, shingle, similarity, id_col, text_col)
    of = "__of"
    while of in docs.columns:  # a caller's column of that name stays
        of += "_"
    keep = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id"), F.col("h").alias("__h")).distinct()
    hashed = docs.withColumn(of, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = hashed.join(keep, hashed[id_col].eqNullSafe(keep["__id"]) & (hashed[of] == keep["__h"]), "left_semi")
    return kept.dropDuplicates([id_col, of]).drop(of)


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
