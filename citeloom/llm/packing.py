"""Packing token sequences into windows by non-negative least squares.

Documents are cut at every window's length; what is left of each (shorter than
a window) is packed. How many remainders have each length is a histogram of at
most ``window - 1`` counts, whatever the corpus. Shallow combinations of lengths
that fill a window exactly are enumerated; non-negative least squares finds how
often to use each, against the histogram; rounded down, these are laid out, and
what is left is packed greedily, longest first.

Defined results: a null or empty text has the closing id alone; texts of any
length are read whole; repeated rows each get their own pieces; an empty table
gives no pieces. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import column_texts, materialize, sliced
from citeloom.llm.units import UnitCache, pieces

# The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_PRINTABLE = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_OWN)))}
_SPACE = chr(_PRINTABLE[ord(" ")])
_PLAIN = re.compile(r" \S{1,64}")  # units that no match of the pattern leaves, short enough for any merging
GROUP = 500  # remainders of one length numbered together


class _Encoder:
    """Ids of texts: the tokenizer's added tokens are read first, as it does, and what lies between by units."""

    def __init__(self, cache: UnitCache, added: dict[str, int]) -> None:
        self.cache = cache
        self.added = {text: array("I", [i]).tobytes() for text, i in added.items()}
        longest = sorted(added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")")

    def texts(self, texts: list[str]) -> list[bytes]:
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not marked:
            return self.cache.texts(texts)
        plain = list(texts)
        for i in marked:
            plain[i] = ""
        out = self.cache.texts(plain)
        for i in marked:
            parts = self.marks.split(texts[i])  # ordinary parts and added tokens by turns
            parts[::2] = self.cache.texts(parts[::2])
            parts[1::2] = [self.added[a] for a in parts[1::2]]
            out[i] = b"".join(parts)
        return out


def ranked(path: str):
    """The tokenizer's merges by rank, and which ids begin with a space; nothing, if its merges are not in order of their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, bytes_of = model["vocab"], {chr(b): b for b in _OWN} | {chr(c): b for b, c in _PRINTABLE.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = {bytes([b]): vocab.get(c, -1) for c, b in bytes_of.items()}
    ranks |= {bytes(map(bytes_of.__getitem__, a + b)): vocab.get(a + b, -1) for a, b in merges}
    in_order = [ranks[bytes(map(bytes_of.__getitem__, a + b))] for a, b in merges]
    least = max(ranks[bytes([b])] for b in range(256))
    if in_order != sorted(set(in_order)) or -1 in ranks.values() or in_order and in_order[0] <= least or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
    opens[[i for text, i in ranks.items() if text[:1] == b" "]] = True
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), opens


def together(units: list[str], encoding, opens: np.ndarray) -> list[bytes] | None:
    """Ids of plain units laid end to end: each begins with the one id that begins with a space."""
    if not units:
        return []
    ids = encoding.encode_to_numpy("".join(units), disallowed_special=()).astype("<u4")
    starts = (4 * np.flatnonzero(opens[ids])).tolist()
    if len(starts) != len(units):
        return None
    raw = ids.tobytes()
    return [raw[s:e] for s, e in zip(starts, [*starts[1:], len(raw)])]


@lru_cache(maxsize=2)
def _worker(path: str) -> _Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, split = Tokenizer.from_file(path), regex.compile(PATTERN)
    model = tokenizer.model

    def ids(piece: str) -> bytes:
        """Ids of one piece; the model reads bytes written as printable characters."""
        if piece.isascii() and piece.isprintable():
            printable = piece.replace(" ", _SPACE)
        else:
            printable = piece.encode().decode("latin-1").translate(_PRINTABLE)
        return array("I", [t.id for t in model.tokenize(printable)]).tobytes()

    by_rank = ranked(path)

    def encode(fresh: list[str]) -> list[bytes]:
        """Plain units together by rank, all others by the tokenizer's model, piece by piece."""
        plain = [u for u in fresh if _PLAIN.fullmatch(u)] if by_rank else []
        told = dict(zip(plain, together(plain, *by_rank) or ())) if by_rank else {}
        cut = {u: pieces(u, split) for u in fresh if u not in told}
        known = {p: ids(p) for p in {p for c in cut.values() for p in c}}
        return [told[u] if u in told else b"".join(map(known.__getitem__, cut[u])) for u in fresh]

    return _Encoder(UnitCache(encode), {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()})


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """The id column and ``ids``: little-endian unsigned 32-bit ids, closed by ``end_id``."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _worker(path)
        for batch in sliced(batches, "body"):
            ids = [x + end for x in cache.texts(column_texts(batch, "body"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    id_type = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(each, f"id {id_type}, ids binary").withColumnRenamed("id", id_col)


def measure(docs: DataFrame, path: str, window: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(id, n, sums): per row its number of ids and the CRC-32 of each piece of up to ``window`` ids."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    end, row = np.array([end_id], dtype="<u4").tobytes(), 4 * window

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _worker(path)
        for batch in sliced(batches, "body", 4 << 20):
            ids = [x + end for x in cache.texts(column_texts(batch, "body"))]
            sums = [[zlib.crc32(x[s : s + row]) for s in range(0, len(x), row)] for x in ids]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(sums, pa.list_(pa.int64()))], names=["id", "n", "sums"])

    id_type = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(each, f"id {id_type}, n long, sums array<long>")


def combinations(present: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Two or three present lengths, longest first, that fill a window exactly."""
    here = set(present.tolist())
    pairs = [(a, window - a) for a in sorted(here, reverse=True) if 2 * a >= window and window - a in here]
    triples = [
        (a, b, window - a - b)
        for a in sorted(here, reverse=True)
        for b in range(min(a, window - a - 1), (window - a - 1) // 2, -1)
        if b in here and window - a - b in here
    ]
    return pairs + triples


def solve(counts: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = 8) -> np.ndarray:
    """Non-negative least squares by coordinate descent: how often each combination is used.

    Minimises the squared difference between the histogram and what the
    combinations take of it; each step sets one count to its best value >= 0.
    """
    left = counts.astype(float).tolist()
    x = [0.0] * len(columns)
    shapes = []
    for c in columns:
        times: dict[int, int] = {}
        for length in c:
            times[length] = times.get(length, 0) + 1
        shapes.append((list(times.items()), float(sum(m * m for m in times.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for j, (parts, norm) in enumerate(shapes):
            step = max(-x[j], sum(m * left[length] for length, m in parts) / norm)
            if step:
                x[j] += step
                moved += abs(step)
                for length, m in parts:
                    left[length] -= m * step
        if moved < 0.5:
            break
    return np.array(x)


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which use up ``counts`` exactly."""
    left = counts.copy()
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], at_most: int) -> None:
        uses = min([at_most, *(int(left[n]) // lengths.count(n) for n in set(lengths))])
        if uses > 0:
            chosen.append((lengths, uses))
            for n in lengths:
                left[n] -= uses

    columns = combinations(np.flatnonzero(left), window)
    repeats = solve(counts, columns)
    for j in np.argsort(-repeats, kind="stable").tolist():
        if repeats[j] < 1:
            break
        take(columns[j], int(repeats[j]))
    while (present := np.flatnonzero(left)).size:  # what is left, longest first
        lengths, space = [], window
        budget = left.copy()
        while (fits := present[(present <= space) & (budget[present] > 0)]).size:
            n = int(fits[-1])
            times = min(space // n, int(budget[n]))
            lengths += [n] * times
            budget[n] -= times
            space -= n * times
        take(tuple(lengths), int(left.max()))
    return chosen


def pack(pieces: DataFrame, window: int, id_col: str = "doc_id") -> DataFrame:
    """Place the pieces of ``measure``'s rows: one row per piece with sequence and offset."""
    pieces = materialize(pieces)
    rest = pieces.withColumn("len", (F.col("n") % window).cast("int")).filter("len > 0")
    found = rest.groupBy("len").count().collect()  # at most window - 1 rows
    counts = np.zeros(window, dtype=np.int64)
    for r in found:
        counts[r["len"]] = r["count"]
    starts: dict[int, list[tuple[int, int, int]]] = {}  # by length: first rank, first sequence, offset
    used, sequences = np.zeros(window, dtype=np.int64), 0
    for lengths, times in plan(counts, window):
        offset = 0
        for n in lengths:
            starts.setdefault(n, []).append((int(used[n]), sequences, offset))
            used[n] += times
            offset += n
        sequences += times
    flat = [(n, *x) for n in sorted(starts) for x in starts[n]]
    key = np.array([n << 44 | first for n, first, _, _ in flat], dtype=np.int64)
    slots = tuple(np.array([f[k] for f in flat], dtype=np.int64) for k in (1, 2, 3))

    # Ranks within a length: groups of about GROUP rows are counted and numbered apart.
    groups = F.element_at(F.array(*[F.lit(int(-(-c // GROUP) or 1)) for c in counts]), F.col("len") + 1)
    rest = rest.withColumn("g", F.pmod(F.xxhash64("id"), groups).cast("int"))
    per_group = rest.groupBy("len", "g").count()
    before = Window.partitionBy("len").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = per_group.select("len", "g", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = rest.withColumn("nth", F.row_number().over(Window.partitionBy("len", "g").orderBy("id")) - 1)
    ranked = ranked.join(base, ["len", "g"]).select(
        "id", "n", "len", (F.col("base") + F.col("nth")).alias("rank"), F.element_at("sums", -1).alias("crc")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            first, sequence, offset = (s[at] for s in slots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(sequence + rank - first), pa.array(offset)],
                names=["id", "n", "length", "crc", "sequence_id", "offset"],
            )

    id_type = pieces.schema["id"].dataType.simpleString()
    ranked = ranked.select("id", "n", F.col("len").cast("long").alias("len"), F.col("rank").cast("long").alias("rank"), "crc")
    short = ranked.mapInArrow(place, f"id {id_type}, n long, length long, crc long, sequence_id long, offset long")
    short = short.withColumn("start", F.col("n") - F.col("length"))
    whole = pieces.select("id", "n", F.posexplode(F.slice("sums", F.lit(1), F.floor(F.col("n") / window).cast("int"))).alias("k", "crc"))
    whole = whole.select(
        "id", "n", F.lit(window).cast("long").alias("length"), "crc",
        (F.monotonically_increasing_id() + F.lit(sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        (F.col("k").cast("long") * window).alias("start"),
    )
    return whole.unionByName(short).select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, path: str, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(measure(docs, path, window, id_col, text_col), window, id_col)
