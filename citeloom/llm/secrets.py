"""Secret scan: all rules in one pass of a combined deterministic automaton.

Defined results: a null or empty text has no spans; texts of any length are read
whole; repeated rows are scanned alike; an empty table gives an empty result.
Only the named id and text columns are read by ``scan``, so other columns may
have any name. ``redact`` passes every other column through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.automaton import compile_rules, run
from citeloom.llm.common import column_bytes, sliced


@dataclass(frozen=True)
class Rule:
    """``head`` drives the automaton: it covers every byte of each match of ``exact``.

    Heads of long runs are kept loose (``+`` for a least length), as counting in
    several rules at once would multiply states; ``exact`` then delimits matches.

    ``size`` is the least length of group ``group`` of the exact expression.
    Rules with ``base`` report leftmost matches that do not overlap; a shorter
    match takes its bytes and is then dropped. The first qualifying match that
    begins within such a dropped one is reported as an additional span.
    """

    kind: str
    head: str
    exact: str
    size: int = 0
    group: int = 0
    base: bool = False


# The kinds of secret and their forms, in the order of report.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6, 2, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]+", 24, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]+", 24),
    Rule("chat", r"xox[abpr]-[A-Za-z0-9\-]+", r"xox[abpr]-[A-Za-z0-9-]+", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_\-.]+", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

_KEYWORD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)")  # begins each match of the rule with a group
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]):
    exact = [re.compile(r.exact.encode()) for r in rules]
    return compile_rules([r.head for r in rules]), exact


def _spans_of(joined: bytes, s: int, e: int, rule_bits: int, rules: tuple[Rule, ...], exact: list) -> Iterator[tuple[int, int, int, bool]]:
    """(rule, start, end, base) of the matches from ``s`` to ``e``, each byte being tried a bounded number of times."""
    for r, rule in enumerate(rules):
        if not rule_bits >> r & 1:
            continue
        long_enough = lambda m: m.end(rule.group) - m.start(rule.group) >= rule.size  # noqa: E731,B023
        for m in exact[r].finditer(joined, s, e):
            if long_enough(m):
                yield r, *m.span(), rule.base
            elif rule.group:  # a match may hide behind this shorter one, which began earlier
                at = m.start() + 1
                while at < m.end() and (word := _KEYWORD.search(joined, at, m.end())):
                    hidden = exact[r].match(joined, word.start(), e)
                    if hidden and long_enough(hidden):
                        yield r, *hidden.span(), False
                        break
                    at = word.start() + 1


def find(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[str, int, int, bool]]]:
    """Spans by index of text, in code points, ordered by start and rule."""
    auto, exact = _compiled(rules)
    joined = b"\xff".join(texts) + b"\xff"  # 0xff is in no UTF-8 text, and leads to state 0
    data = np.frombuffer(joined, dtype=np.uint8)
    states = run(auto, data)
    hits = np.flatnonzero(auto.accepts[states])
    if not len(hits):
        return {}
    idle = np.flatnonzero(states == 0)
    place = np.searchsorted(idle, hits)
    left = np.where(place > 0, idle[place - 1] + 1, 0)
    right = idle[place]
    bits = auto.accepts[states[hits]]
    starts, first = np.unique(left, return_index=True)
    bits = np.bitwise_or.reduceat(bits, first)
    ends = right[first]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(begins, starts, side="right") - 1
    points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
    before = lambda i: int(points[i - 1]) if i else 0
    found: dict[int, list] = {}
    for s, e, b, doc in zip(starts.tolist(), ends.tolist(), bits.tolist(), owner.tolist()):
        base = before(int(begins[doc]))
        for r, x, y, is_base in _spans_of(joined, s, e, b, rules, exact):
            found.setdefault(doc, []).append((before(x) - base, r, before(y) - base, is_base))
    return {d: [(rules[r].kind, x, y, base) for x, r, y, base in sorted(v)] for d, v in found.items()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id and ``spans`` in code points, end exclusive."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in sliced(batches, "body"):
            found = find(column_bytes(batch, "body"), rules)
            rows = [[dict(zip(("kind", "start", "end", "base"), x)) for x in found.get(i, ())] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "spans"])

    id_type = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(each, f"id {id_type}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by ``[kind]``; overlapping spans become one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            found = find(column_bytes(batch, text_col), rules)
            if found:
                texts = batch.column(at).to_pylist()
                for i, spans in found.items():
                    parts, done, text = [], 0, texts[i]
                    for kind, s, e, _ in spans:
                        if s >= done:
                            parts += [text[done:s], f"[{kind}]"]
                        done = max(done, e)
                    texts[i] = "".join(parts) + text[done:]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(each, docs.schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the digest strings of ``scan``'s spans."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
