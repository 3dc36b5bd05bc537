"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Words are maximal runs of digits, a to z (A to Z are lowered first) and characters
from U+0080 on. A window is ``width`` consecutive words of an item; an item of
fewer words, but not none, is one window. Texts and windows are written as their
words with one space around each, so that a window occurs exactly where its bytes
do. Windows are dealt into classes by length. In each class a table of block
shifts says how far the last bytes under the search position prove that no window
ends there; many positions, one in each lane of the text, move on together. Where
the shift is none, the hash of those bytes and of a window's head selects the
windows, which are compared byte for byte.

Windows travel to the tasks in blocks of at most ``most`` (window, item) pairs and
``MOST_BYTES`` bytes, so what is sent is bounded whatever the items are; each
block is one pass over the texts, and passes are combined by row.

Defined results: a null or empty text has no words and no hits; texts of any
length are read whole; repeated rows are answered alike, each with a row of its
own; items that repeat an id count once; a null item id is written as the empty
string; empty tables give empty results or no hits. Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import column_bytes, column_texts, materialize, sliced

MOST_BYTES = 32 << 20
LANE = 1024  # positions of a text that one lane walks
APART = 0xFF  # stands between texts: in no UTF-8 text
DEEP = 256  # bytes of a window that block shifts look at
_ODD = np.uint64(0x9E3779B97F4A7C15)
FOUND = "n_words long, runs array<struct<first:int,last:int>>, items array<string>"

_PLAIN = np.full(256, 0x20, dtype=np.uint8)
_PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def spelt(texts: list[bytes]) -> np.ndarray:
    """The words of all texts, one space around each; a word ``APART`` stands between texts."""
    joined = b" \xff ".join(t.replace(b"\xff", b"\xfe") if b"\xff" in t else t for t in texts)
    data = _PLAIN[np.frombuffer(b" " + joined + b" ", dtype=np.uint8)]
    space = data == 0x20
    return data[~space | np.concatenate([[True], ~space[:-1]])]


def windows(text: bytes, width: int) -> set[bytes]:
    """The windows of an item, as they are written in ``spelt``."""
    words = spelt([text]).tobytes().split()
    return {b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))} if words else set()


def _mixed(block: np.ndarray, head: np.ndarray) -> np.ndarray:
    found = (block * _ODD) ^ (head + (block >> np.uint64(31)))
    return found * _ODD


class Tables:
    """Block shifts and suffix buckets of the windows of one class of lengths."""

    def __init__(self, patterns: list[bytes], block: int) -> None:
        self.least = least = min(DEEP, min(map(len, patterns)))
        self.block = block = min(block, least)
        self.cut = np.uint64(64 - 8 * block)
        self.most = min(255, least - block + 1)
        bits = max(16, int(len(patterns) * (least - block + 1) * 4).bit_length())
        self.slot = np.uint64(64 - min(26, bits))
        heads = np.frombuffer(b"".join(b"\0" * 8 + p[:least] for p in patterns), dtype=np.uint8).reshape(len(patterns), 8 + least)
        self.shift = np.full(1 << min(26, bits), self.most, dtype=np.uint8)
        for end in range(block, least + 1):  # later ends prove less, so they overwrite
            if least - end < self.most:
                self.shift[self._slots(self._at(heads, 8 + end - 8))] = least - end
        self.head = np.uint64((1 << 8 * min(8, least)) - 1)
        keys = _mixed(self._at(heads, least), self._word(heads, 8) & self.head)
        order = np.argsort(keys, kind="stable")
        self.keys, self.patterns = keys[order], [patterns[i] for i in order.tolist()]
        self.sizes = np.array([p.count(b" ") - 1 for p in self.patterns], dtype=np.int64)

    @staticmethod
    def _word(rows: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes of each row from ``at`` on, fewer at the end of a row."""
        part = rows[:, at : at + 8]
        wide = np.zeros((len(rows), 8), dtype=np.uint8)
        wide[:, : part.shape[1]] = part
        return wide.view("<u8")[:, 0]

    def _at(self, rows: np.ndarray, at: int) -> np.ndarray:
        return self._word(rows, at) >> self.cut

    def _slots(self, block: np.ndarray) -> np.ndarray:
        return (block * _ODD) >> self.slot

    def search(self, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence; ``data`` begins and ends with eight bytes that are in no window."""
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        first, last = 8 + self.least - 1, len(data) - 8
        at = np.arange(first, last, LANE)
        limit = np.minimum(at + LANE, last)
        ends = []
        while len(at):
            shift = self.shift[self._slots(eight[at - 7] >> self.cut)]
            ends.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            on = at < limit
            at, limit = at[on], limit[on]
        ends = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
        starts = ends - self.least + 1
        keys = _mixed(eight[ends - 7] >> self.cut, eight[starts] & self.head)
        low = np.searchsorted(self.keys, keys, side="left")
        count = np.searchsorted(self.keys, keys, side="right") - low
        places = np.repeat(starts, count)
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        same = [raw.startswith(self.patterns[w], p) for p, w in zip(places.tolist(), which.tolist())]
        same = np.array(same, dtype=bool)
        return places[same], which[same]


class Matcher:
    """All windows of a block of (window, item) pairs."""

    def __init__(self, pairs: list[tuple[bytes, str]]) -> None:
        items: dict[bytes, list[str]] = {}
        for window, item in pairs:
            items.setdefault(window, []).append(item)
        self.items = items
        self.tables = []
        for low, high, block in ((0, 8, 2), (8, 24, 4), (24, 1 << 62, 8)):
            if some := [w for w in items if low <= len(w) < high]:
                self.tables.append(Tables(some, block))

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its words, the runs of hit words (end exclusive), and the items found, sorted."""
        edge = np.zeros(8, dtype=np.uint8)
        data = np.concatenate([edge, spelt(texts), edge])
        raw = data.tobytes()
        spaces = np.flatnonzero(data == 0x20)
        words = len(spaces) - 1
        apart = np.flatnonzero(data[spaces[:-1] + 1] == APART)
        begins = np.concatenate([[0], apart + 1])
        sizes = np.concatenate([apart, [words]]) - begins
        change = np.zeros(words + 1, dtype=np.int32)
        named: dict[int, set[str]] = {}
        for table in self.tables:
            places, which = table.search(data, raw)
            starts = np.searchsorted(spaces, places)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + table.sizes[which], -1)
            owners = np.searchsorted(begins, starts, side="right") - 1
            for owner, w in set(zip(owners.tolist(), which.tolist())):
                named.setdefault(owner, set()).update(self.items[table.patterns[w]])
        runs: dict[int, list[tuple[int, int]]] = {}
        if named:
            hit = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])
            edges = np.diff(hit)
            first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            owners = np.searchsorted(begins, first, side="right") - 1
            shift = begins[owners]
            for owner, a, b in zip(owners.tolist(), (first - shift).tolist(), (last - shift).tolist()):
                runs.setdefault(owner, []).append((a, b))
        return [(n, runs.get(i, []), sorted(named.get(i, ()))) for i, n in enumerate(sizes.tolist())]


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, item) of every item, each pair once."""
    slim = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("body"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            found = [(w, i) for i, t in zip(column_texts(batch, "item"), column_bytes(batch, "body")) for w in windows(t, width)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([i for _, i in found], pa.string())], names=["window", "item"])

    return slim.mapInArrow(each, "window binary, item string").distinct()


def _pass(docs: DataFrame, keys: list[str], pairs: list[tuple[bytes, str]]) -> DataFrame:
    """One block of windows searched in every text."""
    run = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(pairs)
        for batch in sliced(batches, "body"):
            found = matcher.find(column_bytes(batch, "body"))
            rows = [[{"first": a, "last": b} for a, b in runs] for _, runs, _ in found]
            made = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(rows, run), pa.array([i for _, _, i in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keys] + made, names=[*keys, "n_words", "runs", "items"])

    kept = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "body").mapInArrow(each, f"{kept}, {FOUND}")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, most: int = 100_000
) -> DataFrame:
    """One row per text: its id, ``n_words``, ``runs`` of hit words (end exclusive) and the sorted ``items`` with occurring windows."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    pairs = materialize(item_windows(items, item_col, item_text_col, width))
    total, size = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    blocks = max(1, -(-total // most), -(-size // MOST_BYTES))
    block = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    load = lambda b: [(bytes(r["window"]), r["item"]) for r in pairs.filter(block == b).collect()]
    if blocks == 1:
        found = _pass(slim, ["id"], load(0))
    else:
        own = materialize(slim.withColumn("row", F.monotonically_increasing_id()))
        passes = [_pass(own, ["id", "row"], load(b)) for b in range(blocks)]
        hits = passes[0].select("row", "runs", "items")
        for other in passes[1:]:
            hits = hits.unionByName(other.select("row", "runs", "items"))
        hits = hits.filter(F.size("items") > 0).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        empty = _pass(own, ["id", "row"], []).select("id", "row", "n_words", F.col("runs").alias("none"), F.col("items").alias("nothing"))
        found = empty.join(hits, "row", "left").select("id", "n_words", F.coalesce(_merged("runs"), "none").alias("runs"), F.coalesce("items", "nothing").alias("items"))
    return found.withColumnRenamed("id", id_col)


def _merged(runs: str):
    """Runs of several passes as disjoint runs in order."""
    step = lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last"] >= r["first"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], r["last"]).alias("last")))),
    ).otherwise(F.concat(done, F.array(r)))
    return F.aggregate(F.array_sort(runs), F.expr("cast(array() as array<struct<first:int,last:int>>)"), step)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the items of ``search``'s rows."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["last"] - r["first"]).cast("long"))
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
