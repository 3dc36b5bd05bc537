"""Byte-level BPE in numpy: length-bucketed padded matrices, one merge a row and round.

Defined results: a null text counts as empty and has no ids; texts of any length
are encoded whole; repeated rows get equal ids; an empty table gives an empty
result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import column_texts, sliced
from citeloom.llm.units import UnitCache, pieces

NONE = np.int32(1 << 30)  # rank of a pair that does not merge
CELLS = 256 << 10  # of a matrix
SLICE = 1 << 20  # bytes of text, or of ids, treated at once


class Ranks:
    """Vocabulary of a rank file, with an open-addressing table of its merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(rank.values()) + 1)
        for t, r in rank.items():
            self.tokens[r] = t
        self.byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for t, r in rank.items():
            for k in range(1, len(t)):
                a, b = rank.get(t[:k]), rank.get(t[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(r)
        keys = self._key(np.array(left, dtype=np.uint64), np.array(right, dtype=np.uint64))
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(len(self.keys), NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):  # those that find their slot free take it; the others try the next one
            at = slot[todo] + self.probes
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            chosen, first = np.unique(at[free], return_index=True)
            placed = todo[free][first]
            self.keys[chosen], self.values[chosen] = keys[placed], np.array(merged, dtype=np.int32)[placed]
            todo = np.setdiff1d(todo, placed)
            self.probes += 1

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to, or NONE; a negative id merges with nothing."""
        keys = self._key(a.ravel(), b.ravel())
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, dtype=np.int32)
        for p in range(self.probes):
            out = np.where(self.keys[slot + p] == keys, self.values[slot + p], out)
        return np.where((a.ravel() < 0) | (b.ravel() < 0), NONE, out).reshape(a.shape)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            n = len(p)
            if n:
                width = n if n <= 24 else 1 << (n - 1).bit_length()
                buckets.setdefault(width, []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte[raw], np.int32(-1))
        ranks = self.merge(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        done: list[bytes] = [b""] * len(pieces)

        def finish(which: np.ndarray) -> None:
            for i, row in zip(rows[which].tolist(), ids[which]):
                done[i] = row[row >= 0].astype("<u4").tobytes()

        while ranks.shape[1]:
            best = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), best]
            live = low < NONE
            if not live.all():
                finish(~live)
                ids, ranks, rows, best, low = ids[live], ranks[live], rows[live], best[live], low[live]
                if not len(rows):
                    return done
            # Compaction: what stands right of the merged pair moves one column left.
            n = ids.shape[1]
            span = np.arange(n - 1)
            ids = np.take_along_axis(ids, span + (span > best[:, None]), axis=1)
            each = np.arange(len(rows))
            ids[each, best] = low
            pairs = np.arange(n - 2)
            ranks = np.take_along_axis(ranks, pairs + (pairs >= best[:, None]), axis=1)
            if n > 2:
                right = best < n - 2
                ranks[each[right], best[right]] = self.merge(ids[each[right], best[right]], ids[each[right], best[right] + 1])
                left = best > 0
                ranks[each[left], best[left] - 1] = self.merge(ids[each[left], best[left] - 1], ids[each[left], best[left]])
        finish(np.ones(len(rows), dtype=bool))
        return done


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> tuple[Ranks, UnitCache]:
    ranks, split = Ranks(path), regex.compile(pattern)

    def encode(fresh: list[str]) -> list[bytes]:
        cut = [pieces(u, split) for u in fresh]
        distinct = list({p for c in cut for p in c})
        ids = dict(zip(distinct, ranks.encode([p.encode() for p in distinct])))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    return ranks, UnitCache(encode)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(id, ids) of batches of (id, body)."""
    cache = _worker(path, pattern)[1]
    for batch in sliced(batches, "body", SLICE):
        ids = cache.texts(column_texts(batch, "body"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches with ``decoded``."""
    token = _worker(path, pattern)[0].tokens.__getitem__
    for batch in sliced(batches, "ids", 2 * SLICE):
        ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
        out = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(id, body) and the type of the id."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    return slim, slim.schema["id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``ids``: each text's ids as little-endian unsigned 32-bit integers."""
    slim, kind = _slim(docs, id_col, text_col)
    return slim.mapInArrow(lambda it: _encoded(it, path, pattern), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes that ``ids`` stand for (null for null ids); such a column is replaced."""
    encoded = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lambda it: _decoded(it, path, pattern), f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode``, slice by slice in one worker a task."""
    slim, kind = _slim(docs, id_col, text_col)
    found = slim.mapInArrow(lambda it: _decoded(_encoded(it, path, pattern), path, pattern), f"id {kind}, ids binary, decoded binary")
    return found.withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
