"""Exact repeated substrings, by difference-cover samples and buckets of names.

For a period v a difference cover D holds residues such that any two positions
i and j have some shift k < v that takes both into D. Two equal strings of
``length`` bytes therefore hold, at the same place, two equal windows of
``length - v + 1`` bytes that begin at sampled positions: about one position in
sqrt(v). The construction goes block by block:

1. cover samples are dealt by a hash of their window in buckets; one bucket at a
   time is sorted, which shows the samples whose window occurs again. Only starts
   less than v before such a sample can begin a repeated string; all others are
   settled. A false tie of hashes here only leaves a start open.
2. those starts are dealt in buckets by the name of their whole string and again
   sorted one bucket at a time: a start is repeated if its name ties with a
   neighbour's. Names are hashes of 96 bits; long strings are never compared.
   Before that, the text is cut at break points, which depend on a few bytes
   only, so copies have the same. Runs of starts between two of them are dealt as
   one string; runs that repeat as a whole are settled, and one of each stands
   for its starts. The short strings from one break point to the next are dealt
   too: a start whose string holds one that occurs once is no repeated start.

The same holds for strings of words (``words``): a word's hash then stands where a
byte stands, and white space between words tells nothing.

Texts are numbered once, in units of about ``UNIT`` bytes, and written; a place
is a unit and an offset in it, which no two bytes share. Python holds one slice
of text of ``SLICE`` bytes (or one longer text), ``DEAL`` names, or one bucket.

Defined results: null and empty texts have no bytes; texts shorter than
``length`` keep all; texts of any length are read whole; repeated rows are
copies of each other; an empty table gives an empty result. Only the text column
is read by ``strip``, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import column_bytes, discard, materialize, sliced

UNIT = 1 << 20  # bytes of text numbered together
SLICE = 1 << 19  # bytes of text hashed at once
DEAL = 1 << 18  # names dealt at once
DEALT = "bucket int, kind int, sids binary, counts binary, at binary, h binary, g binary, many binary"
SETTLED = "sid long, at binary, first binary, runs binary"
NAMES, PLACES, RUNS = 0, 1, 2  # kinds of dealt rows: to be sorted; settled places; settled runs
EDGE = 16  # bytes that tell whether a break point is before them
SPACE = np.isin(np.arange(256), [*range(9, 14), 32])  # bytes between words
SHORT = 1 << 31  # added to the place of a string between break points, to tell it from a run's


@lru_cache(maxsize=4)
def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """Period v = q*q + q + 1 and a perfect difference set of q + 1 residues, for a prime q.

    Singer's construction: powers of a generator of the field of q**3 elements
    that lie in a fixed plane.
    """
    v = q * q + q + 1

    def times(x: tuple[int, int, int], c: tuple[int, int, int]) -> tuple[int, int, int]:
        a, b, d = x  # a + b t + d t^2, times t, with t^3 = c0 + c1 t + c2 t^2
        return (d * c[0] % q, (a + d * c[1]) % q, (b + d * c[2]) % q)

    for code in range(q, q**3):
        c = (code % q, code // q % q, code // q // q)
        if not c[0]:
            continue
        x, plane, seen = (1, 0, 0), [], 0
        for i in range(v):
            if x[2] == 0:
                plane.append(i)
            x = times(x, c)
            seen += 1
            if x[1] == 0 and x[2] == 0:
                break
        if seen == v and len(plane) == q + 1:
            return v, np.array(plane)
    raise ValueError(f"no difference cover for {q}")


class Roller:
    """Hashes of all windows of an array of bytes, or of hashes of words: sums of their values times powers of an odd number."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.base, self.inverse = np.uint64(base % (1 << 64)), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        terms = self.values[data] if data.dtype == np.uint8 else data * self.values[0]
        terms *= self.up[: len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, starts: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        h = prefix[starts + width]
        h -= prefix[starts]
        h *= self.down[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


@lru_cache(maxsize=4)
def _roller(seed: int) -> Roller:
    return Roller(seed)


def _cells(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__sid`` and ``__off``: the unit of a text (column ``__body``, which is left out) and its offset there."""
    columns = [c for c in docs.columns if c != "__body"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, at = TaskContext.get().partitionId() << 32, 0
        for batch in sliced(batches, "__body"):
            sids, offs = [], []
            for n in pa.compute.binary_length(batch.column(batch.schema.get_field_index("__body"))).to_pylist():
                if at and at + n > UNIT:
                    unit, at = unit + 1, 0
                sids.append(unit)
                offs.append(at)
                at += n
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sids, pa.int64()), pa.array(offs, pa.int64())], names=[*columns, "__sid", "__off"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "__body")
    return docs.mapInArrow(each, f"{schema}{', ' if schema else ''}__sid long, __off long")


def _groups(h: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order of the names (h, g), the group of each sorted entry, and group sizes."""
    order = np.argsort(h, kind="stable") if g is None else np.lexsort((g, h))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = h[order][1:] != h[order][:-1]
    if g is not None:
        fresh[1:] |= g[order][1:] != g[order][:-1]
    group = np.cumsum(fresh) - 1
    return order, group, np.bincount(group)


class Dealer:
    """Collects names of places and deals them to buckets, packed.

    Names that occur again among those held are settled here; one of each is
    sent on with a mark, so a frequent string costs one entry a deal.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, h: np.ndarray, g: np.ndarray | None, sid: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(h):
            self.held.append((h, g, sid, at.astype("<u4")))
            self.size += len(h)
        if self.size >= DEAL:
            yield from self.deal()

    def deal(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        h, g, sid, at = (None if x[0] is None else np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        order, group, sizes = _groups(h, g)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sent, many = order[first], sizes > 1
        again = np.sort(order[many[group]])
        bucket = ((h[sent] >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        by = np.lexsort((sent, bucket))
        sent, many, bucket = sent[by], many[by], bucket[by]
        rows = []
        for s, e in _runs(bucket):
            part = sent[s:e]
            rows.append((int(bucket[s]), NAMES, *_packed(sid[part]), _halves(at[part]), h[part].tobytes(), b"" if g is None else g[part].tobytes(), np.packbits(many[s:e]).tobytes()))
        if len(again):
            rows.append((int(h[again[0]] % np.uint64(self.buckets)), PLACES, *_packed(sid[again]), _halves(at[again]), b"", b"", b""))
        yield _dealt(rows)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]))


def _packed(sid: np.ndarray) -> tuple[bytes, bytes]:
    """Units in runs and how many places each run has."""
    runs = _runs(sid)
    return sid[[s for s, _ in runs]].astype("<i8").tobytes(), np.array([e - s for s, e in runs], dtype="<u4").tobytes()


def _halves(at: np.ndarray) -> bytes:
    """Places as low halves, then high halves, which come in runs and so take little room in a compressed shuffle."""
    return at.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def _from_halves(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, "<u2").reshape(2, -1).T).view("<u4").ravel()


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("bucket", pa.int32()), ("kind", pa.int32())] + [(k, pa.binary()) for k in ("sids", "counts", "at", "h", "g", "many")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])


def _by_unit(sid: np.ndarray, at: np.ndarray, first: np.ndarray | None) -> pa.RecordBatch:
    """One row per unit with its places, and those that stand for their group."""
    order = np.argsort(sid, kind="stable")
    sid, at = sid[order], at[order].astype("<u4")
    spans = _runs(sid)
    every = [at[s:e].tobytes() for s, e in spans]
    some = [b""] * len(spans)
    if first is not None:
        first = first[order]
        some = [at[s:e][first[s:e]].tobytes() for s, e in spans]
    return _settled(sid[[s for s, _ in spans]], every, some, [b""] * len(spans))


def _settled(sid: np.ndarray, at: list[bytes], first: list[bytes], runs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), *[pa.array(x, pa.binary()) for x in (at, first, runs)]], names=["sid", "at", "first", "runs"])


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket at a time; emit the places whose name occurs more than once."""
    held: list[dict] = []

    def flush() -> Iterator[pa.RecordBatch]:
        read = lambda k, kind: np.concatenate([np.frombuffer(r[k], dtype=kind) for r in held])
        sid, at, h = np.repeat(read("sids", "<i8"), read("counts", "<u4")), np.concatenate([_from_halves(r["at"]) for r in held]), read("h", "<u8")
        g = read("g", "<u4") if held[0]["g"] else None
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(r["h"]) // 8) for r in held])
        order, group, sizes = _groups(h, g)
        keep = ((sizes > 1) | (np.bincount(group, weights=many[order]) > 0))[group]
        if keep.any():
            fresh = np.ones(len(group), dtype=bool)
            fresh[1:] = group[1:] != group[:-1]
            yield _by_unit(sid[order][keep], at[order][keep], fresh[keep])

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == NAMES:
                if held and held[-1]["bucket"] != row["bucket"]:
                    yield from flush()
                    held = []
                held.append(row)
            elif row["kind"] == PLACES:
                yield _by_unit(np.repeat(np.frombuffer(row["sids"], "<i8"), np.frombuffer(row["counts"], "<u4")), _from_halves(row["at"]), None)
            else:
                yield _settled(np.frombuffer(row["sids"], "<i8"), [b""], [b""], [row["at"]])
    if held:
        yield from flush()


def _settle(dealt: DataFrame) -> DataFrame:
    """(sid, at, first, runs): what the buckets found, in several rows a unit."""
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted_buckets, SETTLED)


def _beside(texts: DataFrame, settled: DataFrame, each: Callable, schema: str) -> DataFrame:
    """``each`` over texts in order of unit and offset, every unit's settled rows before its texts (with offset -1)."""
    told = settled.select(F.col("sid").alias("__sid"), F.lit(-1).cast("long").alias("__off"), *[F.col(c).alias(f"__{c}") for c in settled.columns if c != "sid"])
    both = texts.unionByName(told, allowMissingColumns=True)
    return both.repartition("__sid").sortWithinPartitions("__sid", "__off").mapInArrow(each, schema)


class _Told:
    """What the rows of offset -1 have told of the unit at hand."""

    def __init__(self, columns: tuple[str, ...] = ("__at", "__first", "__runs")) -> None:
        self.sid, self.columns, self.cells, self.read = None, columns, {}, {}

    def texts(self, batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, int]]:
        """Slices of texts of one unit; ``places`` then tells of that unit."""
        for batch in sliced(batches, "__body", most):
            sids, offs = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("__sid", "__off"))
            for s, e in _runs(sids):
                if sids[s] != self.sid:
                    self.sid, self.cells, self.read = int(sids[s]), {c: [] for c in self.columns}, {}
                heads = int((offs[s:e] < 0).sum())
                if heads:
                    for c in self.cells:
                        self.cells[c] += [x for x in _cells(batch.slice(s, heads), c) if x]
                if s + heads < e:
                    yield batch.slice(s + heads, e - s - heads), self.sid

    def places(self, column: str) -> np.ndarray:
        if column not in self.read:
            self.read[column] = np.frombuffer(b"".join(self.cells[column]), dtype="<u4").astype(np.int64)
            if not column.endswith("runs"):
                self.read[column] = np.unique(self.read[column])
        return self.read[column]

    def within(self, column: str, low: int, high: int) -> np.ndarray:
        """Places from ``low`` on, less than ``high``, counted from ``low``."""
        found = self.places(column)
        return found[np.searchsorted(found, low) : np.searchsorted(found, high)] - low


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end with a space around each; first byte and end of every word; where a text begins, in bytes and in words."""
    data = np.frombuffer(b"".join([b" ", *[t + b" " for t in texts]]), dtype=np.uint8)
    space = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, end = edges[::2], edges[1::2]
    at = np.cumsum([1] + [len(t) + 1 for t in texts])
    return data, first, end, at, np.searchsorted(first, at)


def _joined(batch: pa.RecordBatch, words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, or the hashes of their words, in one array, where each text begins there, and what to add for its place in the unit."""
    texts = column_bytes(batch, "__body")
    if words:
        data, first, end, _, begins = _words(texts)
        data = _roller(3).windows(_roller(3).prefix(data), first, end - first)
    else:
        data, begins = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0] + [len(t) for t in texts])
    offs = batch.column(batch.schema.get_field_index("__off")).to_numpy()
    return data, begins, offs - begins[:-1]


def _samples(batches: Iterator[pa.RecordBatch], length: int, q: int, buckets: int, words: bool) -> Iterator[pa.RecordBatch]:
    period, cover = difference_cover(q)
    width, roll, dealer = length - period + 1, _roller(1), Dealer(buckets)
    for batch in sliced(batches, "__body", SLICE):
        data, begins, shift = _joined(batch, words)
        sids = batch.column(batch.schema.get_field_index("__sid")).to_numpy()
        at, doc = [], []
        for i, n in enumerate(np.diff(begins).tolist()):
            if n >= length:
                p = (np.arange(0, n - width + 1, period)[:, None] + cover).ravel()
                p = p[p <= n - width]
                at.append(p + begins[i])
                doc.append(np.full(len(p), i))
        if at:
            at, doc = np.concatenate(at), np.concatenate(doc)
            yield from dealer.add(roll.windows(roll.prefix(data), at, width), None, sids[doc], at + shift[doc])
    yield from dealer.deal()


def _regions(batches: Iterator[pa.RecordBatch], length: int, q: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Texts with a repeated sample, and the runs of starts (first, last) that it leaves open."""
    period, _ = difference_cover(q)
    told = _Told()
    for batch, sid in told.texts(batches):
        texts, offs, rows = column_bytes(batch, "__body"), _cells(batch, "__off"), []
        sizes = np.diff(_words(texts)[-1]).tolist() if words else map(len, texts)
        for text, off, n in zip(texts, offs, sizes):
            a, last = told.within("__at", off, off + n), n - length
            low, high = np.maximum(a - period + 1, 0), np.minimum(a, last)
            low, high = low[low <= high], high[low <= high]
            if len(low):
                new = np.ones(len(low), dtype=bool)
                new[1:] = low[1:] > high[:-1] + 1
                pairs = np.column_stack([low[new], high[np.concatenate([new[1:], [True]])]])
                rows.append((off, text, pairs.astype("<u4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sid] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)]],
                names=["__sid", "__off", "__body", "__regions"],
            )


def _blocks(batch: pa.RecordBatch, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of the open starts between break points: prefix sums, text, first and last start; then all open starts and their texts."""
    roll = _roller(1)
    prefix = roll.prefix(data)
    pairs = [np.frombuffer(c, "<u4").reshape(-1, 2).astype(np.int64) for c in _cells(batch, "__regions")]
    doc = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    pairs = np.concatenate(pairs) + begins[doc][:, None]
    sizes = pairs[:, 1] - pairs[:, 0] + 1
    region = np.repeat(np.arange(len(pairs)), sizes)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = pairs[region, 0] + within
    cut = roll.windows(prefix, start, EDGE) >> np.uint64(58) == 0
    cut |= (within == 0) | (start == pairs[region, 1])
    point, of = start[cut], region[cut]
    nexts = np.append(point[1:], -1)
    follows = np.append(of[1:] == of[:-1], False)
    keep = follows | (sizes == 1)[of]
    first, last = point[keep], np.where(follows, nexts, point)[keep]
    return prefix, doc[of[keep]], first, last, start, doc[region]


def _between(prefix: np.ndarray, begins: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, starts and ends of the strings between break points, shorter than ``length``, that a string of an open start holds."""
    n = len(prefix) - 1
    opened = np.zeros(n + 1, dtype=np.int64)
    opened[start + 1] = 1
    np.cumsum(opened, out=opened)  # opened[i]: open starts before i
    cut = np.flatnonzero(_roller(1).windows(prefix, np.arange(n - EDGE + 1), EDGE) >> np.uint64(58) == 0)
    doc = np.searchsorted(begins, cut, side="right") - 1
    inside = cut + EDGE <= begins[doc + 1]
    cut, doc = cut[inside], doc[inside]
    first, end = cut[:-1], cut[1:] + EDGE
    keep = (doc[1:] == doc[:-1]) & (end - first < length)
    keep &= opened[np.minimum(first + 1, n)] > opened[np.maximum(end - length, 0)]
    return doc[:-1][keep], first[keep], end[keep]


def _names(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, width) -> tuple[np.ndarray, np.ndarray]:
    other = _roller(2)
    g = other.windows(other.prefix(data), starts, width) >> np.uint64(32)
    return _roller(1).windows(prefix, starts, width), g.astype("<u4")


def _block_names(batches: Iterator[pa.RecordBatch], length: int, buckets: int, words: bool) -> Iterator[pa.RecordBatch]:
    dealer = Dealer(buckets)
    for batch in sliced(batches, "__body", SLICE):
        data, begins, shift = _joined(batch, words)
        prefix, doc, first, last, start, _ = _blocks(batch, data, begins)
        sids = batch.column(batch.schema.get_field_index("__sid")).to_numpy()
        yield from dealer.add(*_names(data, prefix, first, last - first + length), sids[doc], first + shift[doc])
        doc, first, end = _between(prefix, begins, start, length)
        yield from dealer.add(*_names(data, prefix, first, end - first), sids[doc], first + shift[doc] + SHORT)
    yield from dealer.deal()


def _known(places: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among ``places`` (sorted)."""
    if not len(places):
        return np.zeros(len(asked), dtype=bool)
    return places[np.minimum(np.searchsorted(places, asked), len(places) - 1)] == asked


def _start_names(batches: Iterator[pa.RecordBatch], length: int, buckets: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Names of the starts that are still open, and of one block of each kind that repeats; runs that blocks settle."""
    dealer, told = Dealer(buckets), _Told()
    for batch, sid in told.texts(batches):
        data, begins, shift = _joined(batch, words)
        prefix, doc, first, last, start, owner = _blocks(batch, data, begins)
        place, marks = first + shift[doc], {}
        for column in ("__at", "__first"):
            chosen = _known(told.places(column), place)
            if column == "__at" and chosen.any():
                runs = np.column_stack([place, place + last - first])[chosen].astype("<u4").tobytes()
                yield _dealt([(sid % buckets, RUNS, np.array([sid], "<i8").tobytes(), b"", runs, b"", b"", b"")])
            steps = np.zeros(len(data) + 2, dtype=np.int32)
            np.add.at(steps, first[chosen], 1)
            np.add.at(steps, last[chosen] + 1, -1)
            marks[column] = np.cumsum(steps)[start] > 0
        doc, first, end = _between(prefix, begins, start, length)
        once = ~_known(told.places("__at"), first + shift[doc] + SHORT)
        steps = np.zeros(len(data) + 2, dtype=np.int32)
        np.add.at(steps, np.maximum(end[once] - length, 0), 1)
        np.add.at(steps, first[once] + 1, -1)
        send = (~marks["__at"] | marks["__first"]) & (np.cumsum(steps)[start] == 0)
        at = start[send]
        if len(at):
            yield from dealer.add(*_names(data, prefix, at, length), np.full(len(at), sid), at + shift[owner[send]])
    yield from dealer.deal()


def repeats(texts: DataFrame, length: int = 400, q: int = 13, bucket_bytes: int = 8 << 20, words: bool = False) -> DataFrame:
    """Where strings of ``length`` bytes, or ``words``, occur again, for rows (__sid, __off, __body).

    Returns (sid, at, first, runs): packed starts, and packed (first, last) runs
    of starts; several rows a unit, none for units without any. The place of a
    word is its number in its text, added to that text's offset.
    """
    size = texts.agg(F.sum(F.octet_length("__body")).alias("n")).first()["n"] or 0
    buckets = max(32, -(-size // bucket_bytes))
    sampled = materialize(_settle(texts.mapInArrow(lambda it: _samples(it, length, q, buckets, words), DEALT)))
    opened = materialize(_beside(texts, sampled, lambda it: _regions(it, length, q, words), "__sid long, __off long, __body binary, __regions binary"))
    discard(sampled)
    blocks = materialize(_settle(opened.mapInArrow(lambda it: _block_names(it, length, buckets, words), DEALT)))
    starts = materialize(_settle(_beside(opened, blocks, lambda it: _start_names(it, length, buckets, words), DEALT)))
    discard(opened, blocks)
    return starts


def covered(n: int, at: np.ndarray, runs: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs (start, end) of the bytes that repeated strings cover."""
    first = np.concatenate([at, runs[:, 0]])
    last = np.concatenate([at, runs[:, 1]]) + length
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(last, n), -1)
    inside = np.concatenate([[0], (np.cumsum(steps) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    return edges.reshape(-1, 2)


def _whole(text: bytes, pairs: list[list[int]]) -> None:
    """Narrow spans to whole UTF-8 characters."""
    for p in pairs:
        while p[0] < p[1] and text[p[0]] & 0xC0 == 0x80:
            p[0] += 1
        while p[1] > p[0] and p[1] < len(text) and text[p[1]] & 0xC0 == 0x80:
            p[1] -= 1


def _merged(pairs: list[list[int]]) -> list[list[int]]:
    """Maximal runs of what the spans cover."""
    out: list[list[int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def strip(docs: DataFrame, length: int = 400, text_col: str = "text", whole_characters: bool = False, words: int = 0, apart: bool = False) -> DataFrame:
    """``docs`` with ``spans`` (start and end bytes of what repeats) and ``kept`` (the bytes left).

    With ``whole_characters`` spans are narrowed to whole UTF-8 characters. With
    ``words`` what repeated strings of so many words (32 or more) cover is added, from the first
    byte of a first word to the end of a last one; with ``apart`` it is not cut, but
    told in ``passages`` (start and end bytes). Columns of these names that ``docs``
    had are replaced.
    """
    apart = apart and words > 0
    more = ["passages"] if apart else []
    docs = docs.drop("spans", "kept", *more)
    columns, body = docs.columns, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    numbered = materialize(_numbered(docs.withColumn("__body", body)))
    texts = numbered.withColumn("__body", body)
    found = repeats(texts.select("__sid", "__off", "__body"), length)
    if words:
        also = repeats(texts.select("__sid", "__off", "__body"), words, 5, words=True)
        found = found.unionByName(also.select("sid", F.col("at").alias("word_at"), F.col("runs").alias("word_runs")), allowMissingColumns=True)

    def spans_of(told: _Told, at: str, runs: str, off: int, n: int, size: int) -> list[list[int]]:
        starts, pairs = told.within(at, off, off + n), told.places(runs).reshape(-1, 2) - off
        pairs = pairs[(pairs[:, 0] >= 0) & (pairs[:, 0] < n)]
        return covered(n, starts, pairs, size).tolist() if len(starts) or len(pairs) else []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        told = _Told(("__at", "__runs", "__word_at", "__word_runs") if words else ("__at", "__runs"))
        for batch, _ in told.texts(batches):
            spans, kept, passages = [], [], []
            for text, off in zip(column_bytes(batch, "__body"), _cells(batch, "__off")):
                pairs = spans_of(told, "__at", "__runs", off, len(text), length)
                if whole_characters:
                    _whole(text, pairs)
                of_words = spans_of(told, "__word_at", "__word_runs", off, len(text), words) if words else []
                if of_words:
                    _, first, end, at, _ = _words([text])
                    of_words = [[int(first[s] - at[0]), int(end[e - 1] - at[0])] for s, e in of_words]
                    pairs = pairs if apart else _merged(pairs + of_words)
                passages.append([{"start": s, "end": e} for s, e in of_words])
                spans.append([{"start": s, "end": e} for s, e in pairs])
                ends = [0] + [e for _, e in pairs]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [s for s, _ in pairs] + [len(text)])))
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            told_apart = [pa.array(passages, kind)] if apart else []
            yield pa.RecordBatch.from_arrays([*own, pa.array(spans, kind), pa.array(kept, pa.binary()), *told_apart], names=[*columns, "spans", "kept", *more])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += ", spans array<struct<start:bigint,end:bigint>>, kept binary" + ", passages array<struct<start:bigint,end:bigint>>" * apart
    return _beside(texts, found, each, schema)
