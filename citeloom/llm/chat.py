"""Tool calls and results linked by identifier, ordered, validated and serialised.

All steps are DataFrame functions. Identifiers, which hold within a conversation,
are summarised first (one row each, however many copies a call or result has),
and every message is then hash-joined to its identifier's summary, so copies
never multiply. A call may name the identifiers whose results it needs: its level
is two above the highest of theirs, that of a result one above its call's; a
result is placed after its call even where it was logged before it. Messages stay
one row each, with a position to sort by, so a conversation of any length needs
no large group.

Arguments are read as JSON values with their own types, so the number 5 is no
string, and written again with sorted keys and no spaces. Fields that no schema
names are let through and written; they never make a call valid or invalid.

Defined results: a message without identifier is not linked and keeps its
place; a result without call, or a call without result, has ``linked`` false;
calls that need each other in a circle, or need what such a call gives, have a
null level, as their results; needs without a call count as met; repeated rows
each keep their row; null texts serialise as null; arguments that are no JSON
object, lack a required field or have one of another type are not valid, and are
written as they are if they are no JSON; an empty table gives an empty result.
Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import discard, materialize

FIELDS = ("conv_id", "turn", "role", "kind", "link_id", "name", "arguments", "content")

# Fields that a call's arguments must hold, by function.
SCHEMAS = {"ask": {"text": "string", "turn": "bigint"}}


def from_turns(conversations: DataFrame) -> DataFrame:
    """Tool messages of plain conversations: a user's turn calls ``ask``, the assistant's next turn is its result.

    A call needs the result of the call two turns before it, where there is one:
    that is the exchange which it follows.
    """
    call, result = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    return conversations.select(
        "conv_id", "turn", "role",
        F.when(call, "call").when(result, "result").otherwise("text").alias("kind"),
        F.when(call, name(F.col("turn"))).when(result, name(F.col("turn") - 1)).alias("link_id"),
        F.when(call, "ask").alias("name"),
        F.when(call, F.to_json(F.struct(F.col("text").alias("text"), F.col("turn").alias("turn")))).alias("arguments"),
        F.when(~F.coalesce(call, F.lit(False)), F.col("text")).alias("content"),
        F.when(call, F.array(name(F.col("turn") - 2))).alias("needs"),
    )


# How a schema's types are called for JSON values.
_KINDS = {"string": ("STRING",), "bigint": ("BIGINT",), "boolean": ("BOOLEAN",), "double": ("DOUBLE", "BIGINT")}


def _valid(schemas: dict[str, dict[str, str]]) -> Column:
    """Whether arguments hold every required field, not empty or negative, of the type the schema names."""
    out = F.lit(False)
    for name, fields in schemas.items():
        every = F.lit(True)
        for k, t in sorted(fields.items()):
            kind = F.schema_of_variant(F.try_variant_get("given", f"$.{k}", "variant"))
            value = F.try_variant_get("given", f"$.{k}", t)
            told = kind.isin(*_KINDS[t]) | (F.lit(t == "double") & kind.startswith("DECIMAL"))
            every = every & told & (F.length(value) > 0 if t == "string" else value >= 0 if t != "boolean" else value.isNotNull())
        out = F.when(F.col("name") == name, F.coalesce(every, F.lit(False))).otherwise(out)
    return out


def _along(calls: DataFrame, single: DataFrame) -> DataFrame:
    """(conv_id, link_id, to, steps): where the chain of single needs from each call ends, and how far that is.

    Pointers are doubled, so a chain of n calls takes about log2(n) rounds. Each
    round that settles nothing is the last: what is open then ends in a circle.
    """
    key = ["conv_id", "link_id"]
    ends = calls.join(single.select(*key), key, "left_anti").select(*key, F.col("link_id").alias("to"), F.lit(0).alias("steps"), F.lit(True).alias("done"))
    state = materialize(ends.unionByName(single.select(*key, F.col("need").alias("to"), F.lit(1).alias("steps"), F.lit(False).alias("done"))))
    before, left = None, state.filter("not done").count()
    while left and left != before:
        there = state.select("conv_id", F.col("link_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ended"))
        hop = state.filter("not done").join(there, ["conv_id", "to"])
        hop = hop.select(*key, F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ended").alias("done"))
        old, state = state, materialize(state.filter("done").unionByName(hop))
        discard(old)
        before, left = left, state.filter("not done").count()
    return state.filter("done").select(*key, "to", "steps")


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, link_id, call_level) of ``calls`` (conv_id, link_id): two more than the highest level they need.

    ``needs`` holds a row (conv_id, link_id, need) for each need; repeated rows and
    needs without a call change nothing. Chains of calls that need one other are
    followed by doubling; a call that needs several is settled once all of these
    are, so rounds grow with the number of such calls in a row, not with the
    length of chains. A call of a circle, or behind one, stays out.
    """
    key = ["conv_id", "link_id"]
    calls = materialize(calls.select(*key).distinct())
    known = calls.select("conv_id", F.col("link_id").alias("need"))
    edges = materialize(needs.select(*key, "need").distinct().join(known, ["conv_id", "need"], "left_semi"))
    counted = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("need"))
    chains = materialize(_along(calls, counted.filter("n = 1").select(*key, "need")))
    several = counted.filter("n > 1").select(*key)
    found = materialize(calls.join(edges.select(*key).distinct(), key, "left_anti").select("conv_id", F.col("link_id").alias("to"), F.lit(0).alias("base")))
    ends = chains.select("conv_id", F.col("link_id").alias("need"), "to", "steps")
    waiting = materialize(edges.join(several, key, "left_semi").join(ends, ["conv_id", "need"], "left").select(*key, "to", "steps"))
    while not waiting.isEmpty():
        given = waiting.join(found, ["conv_id", "to"], "left")
        ready = given.groupBy(*key).agg(F.count_if(F.col("base").isNull()).alias("open"), F.max(F.col("base") + 2 * F.col("steps") + 2).alias("base"))
        ready = materialize(ready.filter("open = 0").select("conv_id", F.col("link_id").alias("to"), "base"))
        if ready.isEmpty():
            break
        found = materialize(found.unionByName(ready))
        waiting = materialize(waiting.join(ready.select("conv_id", F.col("to").alias("link_id")), key, "left_anti"))
    discard(calls, edges, waiting)
    return chains.join(found, ["conv_id", "to"]).select(*key, (F.col("base") + 2 * F.col("steps")).alias("call_level"))


def link(messages: DataFrame, schemas: dict[str, dict[str, str]] = SCHEMAS) -> DataFrame:
    """Each message with ``linked``, ``valid``, its ``level``, ``position`` and canonical ``json``; a column ``needs`` (array of identifiers) is optional."""
    is_call, key = F.col("kind") == "call", ["conv_id", "link_id"]
    messages = messages.select(*FIELDS, *[c for c in ("needs",) if c in messages.columns])
    named = messages.filter("link_id is not null and conv_id is not null")
    summary = named.groupBy(*key).agg(
        F.count_if(is_call).alias("calls"),
        F.count_if(~is_call).alias("results"),
        F.min(F.when(is_call, F.col("turn"))).alias("call_turn"),
    )
    if "needs" in messages.columns:
        called = named.filter(is_call)
        summary = summary.join(levels(called, called.select(*key, F.explode("needs").alias("need"))), key, "left")
    else:
        summary = summary.withColumn("call_level", F.lit(0))
    named, messages = named.select(*FIELDS), messages.select(*FIELDS)
    joined = named.join(summary.hint("shuffle_hash"), key)
    apart = messages.filter("link_id is null or conv_id is null").withColumns({"calls": F.lit(0), "results": F.lit(0), "call_turn": F.lit(None).cast("long"), "call_level": F.lit(0)})
    every = joined.unionByName(apart)
    linked = (F.col("calls") > 0) & (F.col("results") > 0)
    after = (F.col("kind") == "result") & linked
    every = every.withColumn("given", F.try_parse_json("arguments")).withColumns({
        "linked": linked,
        "valid": F.when(is_call, _valid(schemas)),
        "level": F.when(after, F.col("call_level") + 1).when(is_call, F.col("call_level")).otherwise(0).cast("int"),
        "position": F.when(after, 2 * F.greatest("turn", "call_turn") + 1).otherwise(2 * F.col("turn")),
        "arguments": F.coalesce(F.to_json("given"), F.col("arguments")),
    })
    # Keys in sorted order, no spaces, absent fields left out: one form for equal messages.
    fields = ("arguments", "content", "conv_id", "kind", "link_id", "linked", "name", "role", "turn", "valid")
    return every.withColumn("json", F.to_json(F.struct(*fields))).select(
        "conv_id", "turn", "role", "kind", "link_id", "linked", "valid", "level", "position", "json"
    )


ORACLE = """
WITH m AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'text' END AS kind,
    CASE WHEN role = 'user' THEN conv_id::VARCHAR || '-' || turn::VARCHAR
         WHEN role = 'assistant' THEN conv_id::VARCHAR || '-' || (turn - 1)::VARCHAR END AS link_id
  FROM conversations),
s AS (
  SELECT link_id, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind <> 'call') AS results,
    min(turn) FILTER (kind = 'call') AS call_turn
  FROM m WHERE link_id IS NOT NULL GROUP BY link_id),
d AS (
  SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user')),
l AS (
  SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS link_id,
    (2 * row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 2)::INTEGER AS call_level
  FROM d),
j AS (
  SELECT m.*, coalesce(calls > 0 AND results > 0, false) AS linked, call_turn, call_level
  FROM m LEFT JOIN s USING (link_id) LEFT JOIN l USING (link_id)),
k AS (
  SELECT *, CASE WHEN kind = 'call' THEN coalesce(length(text) > 0 AND turn >= 0, false) END AS valid,
    CASE WHEN kind = 'result' AND linked THEN call_level + 1 WHEN kind = 'call' THEN coalesce(call_level, 0) ELSE 0 END AS level,
    CASE WHEN kind = 'result' AND linked THEN 2 * greatest(turn, call_turn) + 1 ELSE 2 * turn END AS position
  FROM j)
SELECT conv_id, turn, role, kind, link_id, linked, valid, level, position,
  '{' || concat_ws(',',
    CASE WHEN kind = 'call' THEN '"arguments":' || to_json('{' || concat_ws(',',
      '"text":' || to_json(text)::VARCHAR, '"turn":' || turn::VARCHAR) || '}')::VARCHAR END,
    CASE WHEN kind <> 'call' THEN '"content":' || to_json(text)::VARCHAR END,
    '"conv_id":' || conv_id::VARCHAR, '"kind":' || to_json(kind)::VARCHAR,
    '"link_id":' || to_json(link_id)::VARCHAR, '"linked":' || linked::VARCHAR,
    CASE WHEN kind = 'call' THEN '"name":"ask"' END, '"role":' || to_json(role)::VARCHAR,
    '"turn":' || turn::VARCHAR, '"valid":' || valid::VARCHAR) || '}' AS json
FROM k
"""
