"""Conversation structure repair: cheapest edits by Four-Russians block tables.

A conversation's role initials shall read ``(s?(ua)+)?``. Rows are kept (0), given
the role user or assistant (2) or deleted (3, required for blank and duplicate
rows); rows of user or assistant without text are put in (2); a truncated row
that stays costs 1 more. What the rows from some place on still cost is a vector
over the four places of the grammar. Less its least entry it is one of few, so
what a block of ``BLOCK`` rows makes of each such vector is computed beforehand
for every block. Rows are processed by looking their blocks up, from the last to
the first; a block is then expanded backward, row by row, from the vector at its
right, and the edits are read forward along the cheapest ones, the ASCII-least
first. A kept row of role s can only lead, so the edits' letters tell all roles.

Nothing needs a whole conversation in one task: rows are dealt by ranges of
(conversation, turn), a task cuts its part of a conversation in pieces of at most
``PIECE`` rows or ``PIECE_BYTES`` bytes of text, and each piece is reduced to what
it makes of every vector. A stream over these small rows, backward, gives every
piece the vector at its right; a stream over the pieces, forward, writes the
edits. Both hold one piece at a time. The checksum of a repaired conversation is
sequential by nature, so the last stream is the one place that a very long
conversation passes row by row. The audit and the counts come with it.

Defined results: null roles and texts are one space, so such a text is blank; a
null id or turn is one space where the checksum is taken, null ids are one
conversation, and null turns come first; rows of a conversation that share a turn
come by role, then by the first 64 code points of the text, then by its SHA-256,
repeated rows side by side; an empty role has no initial and cannot be kept;
texts of any length are whole; an empty table gives an empty result. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize, sliced

BLOCK = 4
PIECE = 4096
PIECE_BYTES = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# Places of the grammar: nothing yet, after s, after u, after a. NEXT is the place after a user or an assistant that is put there.
PLACES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
# Symbols of rows: 0 stands for no row, 1 for one that must go, then initials s, u, a and others, each whole and truncated.
INITIALS = "sua"
SYMBOLS = 10
_FAR = 1 << 20
_SPACE = "[^\\x20\\x09-\\x0D]"


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs with rows put in wherever that is cheaper."""
    costs = list(costs)
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


@lru_cache(maxsize=None)
def edits(symbol: int, place: int) -> list[tuple[str, int, int]]:
    """(edit, cost, place after it) of a row in ASCII order, without rows put in before it."""
    if symbol == 0:
        return [("", 0, place)]
    found = [("D", DELETE, place)]
    if symbol > 1:
        initial, late = (INITIALS + "-")[(symbol - 2) // 2], TRUNCATED * ((symbol - 2) % 2)
        if (place, initial) in PLACES:
            found.append(("K", KEEP + late, PLACES[place, initial]))
        found.append(("R", REROLE + late, NEXT[place]))
    return found


@lru_cache(maxsize=1 << 14)
def step(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from before a row on, by those from after it on."""
    return _closed([min(cost + after[to] for _, cost, to in edits(symbol, q)) for q in range(4)])


LAST = _closed([0 if q in ENDS else _FAR for q in range(4)])


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All normalised vectors (the last one's first), and by vector and block of symbols the vector before it and the cost taken off."""
    less = lambda v: (tuple(x - min(v) for x in v), min(v))
    vectors, at = [less(LAST)[0]], 0
    known = {vectors[0]: 0}
    to, cost = [], []
    while at < len(vectors):
        row = [less(step(s, vectors[at])) for s in range(SYMBOLS)]
        for v, _ in row:
            if v not in known:
                known[v] = len(vectors)
                vectors.append(v)
        to.append([known[v] for v, _ in row])
        cost.append([c for _, c in row])
        at += 1
    one, one_cost = np.array(to), np.array(cost)
    to, cost = one, one_cost
    for _ in range(BLOCK - 1):  # the block's first row is its code's highest digit, and is met last
        wide = one[to].transpose(0, 2, 1).reshape(len(vectors), -1)
        cost = (cost[:, :, None] + one_cost[to]).transpose(0, 2, 1).reshape(len(vectors), -1)
        to = wide
    return vectors, to, cost


def blocks(symbols: bytes) -> np.ndarray:
    """Codes of the blocks of a piece; the first one is filled up with no rows."""
    padded = bytes(-len(symbols) % BLOCK) + symbols
    digits = np.frombuffer(padded, dtype=np.uint8).reshape(-1, BLOCK).astype(np.int64)
    return digits @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def effect(symbols: bytes) -> tuple[list[int], list[int]]:
    """What a piece makes of every vector at its right: the vector at its left, and the cost taken off."""
    vectors, to, cost = tables()
    at, total = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
    for code in blocks(symbols)[::-1].tolist():
        total += cost[at, code]
        at = to[at, code]
    return at.tolist(), total.tolist()


def traced(symbols: bytes, right: int, place: int) -> tuple[str, list[str], int]:
    """Edits of a piece, cheapest and then ASCII-least, the roles that they give its output, and the place after it.

    Blocks are looked up from the right for the vector at each block's right, then
    expanded backward row by row. Edits that put rows in before a row are here.
    """
    vectors, to, _ = tables()
    codes = blocks(symbols).tolist()
    rights = [right]
    for code in codes[:0:-1]:
        rights.append(int(to[rights[-1], code]))
    padded = bytes(-len(symbols) % BLOCK) + symbols
    audit, roles = [], []
    for b, vector in zip(range(len(codes)), reversed(rights)):
        rows = padded[b * BLOCK : (b + 1) * BLOCK]
        costs = [vectors[vector]]
        for symbol in reversed(rows):
            costs.append(step(symbol, costs[-1]))
        costs.reverse()
        for k, symbol in enumerate(rows):
            if symbol == 0:
                continue
            done = False
            while not done:
                here, after = costs[k], costs[k + 1]
                options = [(e, to_, True) for e, c, to_ in edits(symbol, place) if c + after[to_] == here[place]]
                if INSERT + here[NEXT[place]] == here[place]:
                    options.append(("I", NEXT[place], False))
                letter, place_, done = min(options)
                audit.append(letter)
                roles.append("" if letter in "DK" else ("user", "assistant")[place_ == 3])
                place = place_
    return "".join(audit), roles, place


def ending(place: int) -> tuple[str, list[str]]:
    """Rows put in after the last one."""
    audit, roles = "", []
    while place not in ENDS:
        place = NEXT[place]
        audit += "I"
        roles.append(("user", "assistant")[place == 3])
    return audit, roles


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults put in by a checksum of their id and turn; a dropped row stays, marked, for its conversation's sake."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(told(id_col), F.lit(":"), told(turn_col)), "UTF-8")) % 20
    text = told(text_col)
    slim = rows.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.when(fault == 4, "user").otherwise(told(role_col)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("gone"),
        F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("times"),
    )
    return slim.withColumn("time", F.explode("times")).drop("times", "time")


def symbol(role: Column, text: Column, seen: Column) -> Column:
    """The symbol of a row; see ``SYMBOLS``."""
    late = F.when(F.rlike(text, F.lit(f"[.!?][\\x20\\x09-\\x0D]*\\z")), 0).otherwise(1)
    kind = F.greatest(F.instr(F.lit(INITIALS), F.substring(role, 1, 1)), F.lit(0))
    kind = F.when((role == "") | (kind == 0), len(INITIALS) + 1).otherwise(kind)
    return F.when(~F.rlike(text, F.lit(_SPACE)) | seen, 1).otherwise(2 * kind + late)


def faults(rows: DataFrame) -> DataFrame:
    """Rows of ``damage``, in order within ranges, with the symbol, the fault and a number that rises along each conversation."""
    digest = F.unhex(F.sha2(F.to_json(F.struct(F.col("conv").cast("string").alias("c"), "role", "text")), 256))
    own = materialize(rows.withColumns({"digest": digest, "row": F.monotonically_increasing_id()}))
    alike = own.filter("not gone").groupBy("digest").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = own.join(alike.select("digest", F.col("first")["row"].alias("first")), "digest", "left")
    seen = F.coalesce(F.col("first") != F.col("row"), F.lit(False))
    blank = ~F.rlike("text", F.lit(_SPACE))
    code = F.when(F.col("gone"), 0).otherwise(symbol(F.col("role"), F.col("text"), seen))
    whole = marked.select(
        "conv", "turn", "role", "text", "digest", "row", code.alias("symbol"),
        F.when(F.col("gone"), "").when(blank, "b").when(seen, "d").when(code % 2 == 1, "t").otherwise("").alias("fault"),
        F.substring("text", 1, 64).alias("head"),
    )
    order = ["conv", "turn", "role", "head", "digest", "row"]
    return whole.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "digest", "row").withColumn("at", F.monotonically_increasing_id())


_PIECES = (
    "at long, symbols binary, roles array<string>, texts array<string>, rows long, blank long, duplicate long, truncated long, illegal long, "
    "opening string, closing string, low long, high long, turns long, to array<int>, cost array<long>"
)


def pieces(rows: DataFrame, most: int = PIECE, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """Rows of ``faults``, packed in pieces of a conversation with their counts and their effect on every vector."""

    def packed(conv, held: list) -> dict:
        live = [r for r in held if r[4]]
        turns = [r[1] for r in live if r[1] is not None]
        initials = [r[2][:1] for r in live]
        symbols = bytes(r[4] for r in held)
        to, cost = effect(symbols)
        count = lambda x: sum(r[5] == x for r in held)
        return {
            "conv": conv, "at": held[0][0], "symbols": symbols, "roles": [r[2] for r in held], "texts": [r[3] for r in held],
            "rows": len(live), "blank": count("b"), "duplicate": count("d"), "truncated": count("t"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "opening": initials[0] if live else None, "closing": initials[-1] if live else None,
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)), "to": to, "cost": cost,
        }

    conv_type = rows.schema["conv"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        conv, held, size, out, out_size = None, [], 0, [], 0
        for batch in sliced(batches, "text"):
            if schema is None:
                kinds = {"symbols": pa.binary(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "opening": pa.string(), "closing": pa.string(), "to": pa.list_(pa.int32()), "cost": pa.list_(pa.int64())}
                names = ["conv"] + [c.split()[0] for c in _PIECES.split(", ")]
                schema = pa.schema([(n, batch.schema.field("conv").type if n == "conv" else kinds.get(n, pa.int64())) for n in names])
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "at", "turn", "role", "text", "symbol", "fault")]
            for c, *row in zip(*columns):
                if held and (c != conv or len(held) >= most or size >= most_bytes):
                    out.append(packed(conv, held))
                    out_size += size + 1000
                    held, size = [], 0
                    if out_size >= most_bytes:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, out_size = [], 0
                conv = c
                held.append(row)
                size += len(row[3])
        if held:
            out.append(packed(conv, held))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(each, f"conv {conv_type}, {_PIECES}")


_SUMS = "at long, right int, leads boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def sums(parts: DataFrame) -> DataFrame:
    """For every piece the vector at its right; with a conversation's first piece its counts and cost.

    A stream over pieces from last to first that holds one piece's numbers.
    """
    slim = parts.drop("symbols", "roles", "texts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = tables()[0]
        last, total = None, None

        def told(r: dict, right: int) -> dict:
            start = vectors[total["vector"]][0] + total["cost"]
            gaps = total["high"] - total["low"] + 1 - total["turns"] if total["high"] is not None else 0
            return {"conv": r["conv"], "at": r["at"], "right": right, "leads": True, "gaps": gaps, **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": start}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if last is not None and last[0]["conv"] == r["conv"]:
                    out.append({"conv": last[0]["conv"], "at": last[0]["at"], "right": last[1], "leads": False})
                else:
                    if last is not None:
                        out.append(told(*last))
                    total = {"vector": 0, "cost": min(LAST), "high": None, "low": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "opening": None}
                last = (r, total["vector"])
                total["cost"] += r["cost"][total["vector"]]
                total["vector"] = r["to"][total["vector"]]
                for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    total[k] += r[k]
                if r["high"] is not None:
                    total["turns"] -= r["high"] == total["low"]
                    total["high"] = r["high"] if total["high"] is None else total["high"]
                    total["low"] = r["low"]
                if r["rows"]:
                    total["illegal"] += total["opening"] is not None and r["closing"] + total["opening"] not in ("su", "ua", "au")
                    total["opening"] = r["opening"]
            if out:
                yield pa.RecordBatch.from_pylist(out, _schema(batch, _SUMS))
        if last is not None:
            yield pa.RecordBatch.from_pylist([told(*last)], _schema(batch, _SUMS))

    conv_type = parts.schema["conv"].dataType.simpleString()
    placed = slim.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("at"))
    return placed.mapInArrow(each, f"conv {conv_type}, {_SUMS}")


def _schema(batch: pa.RecordBatch, columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([("conv", batch.schema.field("conv").type)] + [(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))])


_REPAIRED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = PIECE, repaired: bool = False) -> DataFrame:
    """One row per conversation of ``rows``, which are damaged first: counts, cost, audit and the repaired text's SHA-256.

    With ``repaired``, one row per row of the repaired conversations instead:
    id, ``nth`` from 0, role and text.
    """
    parts = materialize(pieces(faults(damage(rows, id_col, turn_col, role_col, text_col)), most))
    ends = sums(parts).withColumns({"kind": F.lit(0)}).withColumnRenamed("cost", "spent")
    both = parts.select("conv", "at", "symbols", "roles", "texts", F.lit(1).alias("kind")).unionByName(ends, allowMissingColumns=True)
    placed = both.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "at", "kind")
    conv_type = parts.schema["conv"].dataType.simpleString()
    columns = "nth long, role string, text string" if repaired else _REPAIRED

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, audit, place, right, nth, hashed = None, [], 0, 0, 0, hashlib.sha256()

        def lines(roles: list[str], own: Iterator[tuple[str, str]], letters: str) -> Iterator[tuple[str, str]]:
            for letter, role in zip(letters, roles):
                if letter == "I":
                    yield role, ""
                    continue
                was, text = next(own)
                if letter != "D":
                    yield role or was, text

        def end() -> Iterator[dict]:
            letters, roles = ending(place)
            audit.append(letters)
            for line in lines(roles, iter(()), letters):
                yield from put(line)
            if not repaired:
                yield {"conv": head["conv"], **{k: head[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")}, "cost": head["spent"], "audit": "".join(audit), "repaired_sha256": hashed.hexdigest()}

        def put(line: tuple[str, str]) -> Iterator[dict]:
            nonlocal nth
            if repaired:
                yield {"conv": head["conv"], "nth": nth, "role": line[0], "text": line[1]}
            else:
                hashed.update((("\n" if nth else "") + f"{line[0]}:{line[1]}").encode())
            nth += 1

        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                out = []
                if r["kind"] == 0:
                    right = r["right"]
                    if r["leads"]:
                        if head is not None:
                            out.extend(end())
                        head, audit, place, nth, hashed = r, [], 0, 0, hashlib.sha256()
                else:
                    letters, roles, place = traced(r["symbols"], right, place)
                    audit.append(letters)
                    own = ((a, b) for a, b, s in zip(r["roles"], r["texts"], r["symbols"]) if s)
                    for line in lines(roles, own, letters):
                        out.extend(put(line))
                if out:
                    yield pa.RecordBatch.from_pylist(out, _schema(batch, columns))
        if head is not None:
            if out := list(end()):
                yield pa.RecordBatch.from_pylist(out, _schema(batch, columns))

    return placed.mapInArrow(each, f"conv {conv_type}, {columns}").withColumnRenamed("conv", id_col)
