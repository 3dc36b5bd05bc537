"""Decision records: reading model output, gates, supersession and audits."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.config import SETTINGS
from citeloom.functions import outputs, policy
from citeloom.functions.text import trimmed
from citeloom.session import keep, shared_dir

ITEM = "struct<topic:string,summary:string,alternativesConsidered:array<string>,confidence:string,touchedPaths:array<string>>"


_FENCE = re.compile(r"^```(?:json)?\s*(.*?)```$", re.I | re.S)
_PART = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}]', re.S)
_JSON = json.JSONDecoder()


def balanced(raw: str) -> str:
    """The first balanced object or array of a text without its fence; the rest of the text if it never closes."""
    text = raw.strip()
    if fenced := _FENCE.match(text):
        text = fenced[1].strip()
    begin = re.search(r"[\[{]", text)
    if not begin:
        return text
    try:  # sound JSON ends where its brackets do
        return text[begin.start() : _JSON.raw_decode(text, begin.start())[1]]
    except (ValueError, RecursionError):
        pass
    opens, depth = begin[0], 0
    closes = "}" if opens == "{" else "]"
    for part in _PART.finditer(text, begin.start()):
        depth += (part[0] == opens) - (part[0] == closes)
        if not depth:
            return text[begin.start() : part.end()]
    return text[begin.start() :]


def first_json(raw: Column) -> Column:
    """``balanced`` of each text, batch by batch: a scan that built-in functions lack."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(balanced, na_action="ignore")

    each.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, "string")(raw)


def parsed(outputs: DataFrame, column: str = "raw") -> DataFrame:
    """Adds ``decisions`` (list of records, missing lists empty) and ``valid``: null and false for bad output."""
    outputs = outputs.withColumn("__json", first_json(F.col(column)))
    text = F.col("__json")
    is_list, is_object = F.startswith(text, F.lit("[")), F.startswith(text, F.lit("{"))  # other texts are not read
    outputs = outputs.withColumn("__wrapped", F.when(is_object, F.from_json(text, f"struct<decisions:array<{ITEM}>>")["decisions"]))
    wrapped = F.col("__wrapped")
    listed = F.from_json(text, f"array<{ITEM}>")
    single = F.from_json(text, ITEM)
    found = F.when(is_list, listed).when(wrapped.isNotNull(), wrapped).when(is_object & single["topic"].isNotNull() & single["summary"].isNotNull(), F.array(single))
    number = lambda d: d["confidence"].try_cast("double")
    empty = F.array().cast("array<string>")
    clean = F.transform(found, lambda d: F.struct(
        d["topic"].alias("topic"), d["summary"].alias("summary"), F.coalesce(d["alternativesConsidered"], empty).alias("alternatives"),
        number(d).alias("confidence"), F.coalesce(d["touchedPaths"], empty).alias("touched_paths"),
    ))
    sound = lambda d: F.coalesce(
        F.length(d["topic"]).between(1, SETTINGS.topic_chars) & (F.length(d["summary"]) >= 1) & d["confidence"].between(0.0, 1.0), F.lit(False)
    )
    return outputs.withColumn("decisions", clean).withColumn("valid", F.coalesce(F.forall("decisions", sound), F.lit(False))).drop("__json", "__wrapped")


def gated(decisions: DataFrame, least: float = SETTINGS.min_confidence) -> DataFrame:
    """Drop weak decisions and those that name a contrast without an alternative; trust only real paths.

    Expects topic, summary, alternatives, confidence, touched_paths, title, body, git_paths.
    """
    quality = policy.alternatives_quality(F.col("alternatives"), F.col("summary"), F.col("title"), F.col("body"))
    kept = decisions.filter((F.col("confidence") >= least) & (quality != "inconsistent"))
    return kept.withColumn("touched_paths", outputs.trusted_paths(F.col("touched_paths"), F.col("git_paths")))


def audit(decisions: DataFrame) -> DataFrame:
    """Counts and shares, to one decimal, of the quality of alternatives."""
    quality = policy.alternatives_quality(F.col("alternatives"), F.col("summary"), F.col("title"), F.col("body"))
    counts = decisions.groupBy(quality.alias("bucket")).agg(F.count("*").alias("n"))
    total = decisions.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("bucket", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))


def neighbours(decisions: DataFrame, floor: float = SETTINGS.supersede_floor, block: int = 1024) -> DataFrame:
    """Pairs of decisions of a repository whose similarity reaches ``floor``: the later one's ``id`` and ``place``, the earlier ``other``.

    Expects repo_id, id, ord, decided_at, source_type and a unit ``vector``;
    documents take no part. Vectors are packed in blocks of a repository and
    each two blocks are multiplied as matrices in some task, so a large
    repository is spread, and only pairs above the floor become rows.
    """
    able = decisions.filter("source_type <> 'doc'").select("repo_id", "id", "ord", "decided_at", "vector")
    sizes = able.groupBy("repo_id").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = able.join(sizes, "repo_id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    member = F.struct(F.struct("ord", "id").alias("place"), "decided_at", "vector")
    packed = dealt.groupBy("repo_id", "block").agg(F.collect_list(member).alias("members"))  # about ``block`` members
    other = packed.select("repo_id", F.col("block").alias("other_block"), F.col("members").alias("others"))
    met = packed.join(other, "repo_id").filter("other_block >= block")
    slim = met.select("repo_id", F.transform("members", lambda m: m["vector"]).alias("a"), F.transform("others", lambda m: m["vector"]).alias("b"), "members", "others")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("a"), batch.column("b")):
                left, right = (np.array(v.as_py(), dtype=float) for v in (x, y))
                scores = np.round(left @ right.T, 6)
                i, j = np.nonzero(scores >= floor)
                found.append([{"i": int(p), "j": int(q), "score": float(s)} for p, q, s in zip(i, j, scores[i, j])])
            kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("score", pa.float64())]))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("repo_id", "left", "right")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind)], names=["repo_id", "left", "right", "found"])

    told = lambda k: F.transform(k, lambda m: F.struct(m["place"].alias("place"), m["decided_at"].alias("decided_at")))
    slim = slim.select("repo_id", "a", "b", told(F.col("members")).alias("left"), told(F.col("others")).alias("right"))
    kind = slim.schema["left"].dataType.simpleString()
    repo = slim.schema["repo_id"].dataType.simpleString()
    pairs = slim.mapInArrow(each, f"repo_id {repo}, left {kind}, right {kind}, found array<struct<i:int,j:int,score:double>>")
    flat = pairs.select("repo_id", "left", "right", F.explode("found").alias("f"))
    flat = flat.select("repo_id", F.col("left")[F.col("f.i")].alias("x"), F.col("right")[F.col("f.j")].alias("y"), F.col("f.score").alias("score")).filter("x.place <> y.place")
    later = F.col("x.place") > F.col("y.place")
    ends = flat.select("repo_id", "score", F.when(later, F.col("x")).otherwise(F.col("y")).alias("now"), F.when(later, F.col("y")).otherwise(F.col("x")).alias("old")).dropDuplicates(["now", "old"])
    return ends.select(
        "repo_id", F.col("now.place.id").alias("id"), F.col("now.place").alias("place"), F.col("old.place.id").alias("other"), F.col("old.place").alias("other_place"),
        "score", (F.col("now.decided_at") > F.col("old.decided_at")).alias("newer"),
    )


GROUP = 32  # packs that a reader holds at once, whatever they compress to


def _packed(decisions: DataFrame, block: int) -> DataFrame:
    """Decisions of each repository in order of processing, in packs of at most ``block``: ids, decided, the matrix, and ``nth`` of how many packs.

    A large repository is dealt over many tasks. A decision that comes again with the same place is taken once.
    """
    able = decisions.filter("source_type <> 'doc' and vector is not null and repo_id is not null").select("repo_id", "ord", "id", "decided_at", F.col("vector").cast("array<double>").alias("vector"))
    dealt = able.repartitionByRange("repo_id", "ord", "id").sortWithinPartitions("repo_id", "ord", "id")
    repo, key, when = (able.schema[c].dataType.simpleString() for c in ("repo_id", "id", "decided_at"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, seq, kinds = None, 0, None

        def emit() -> pa.RecordBatch:
            matrix = np.array([r[3] for r in held], dtype=np.float64)
            made = [pa.array([held[0][0]], kinds["repo_id"]), pa.array([seq], pa.int64()), pa.array([[r[1] for r in held]], pa.list_(kinds["id"])), pa.array([[r[2] for r in held]], pa.list_(kinds["decided_at"]))]
            return pa.RecordBatch.from_arrays([*made, pa.array([matrix.tobytes()], pa.binary())], names=["repo_id", "seq", "ids", "decided", "matrix"])

        for batch in batches:
            kinds = kinds or {f.name: f.type for f in batch.schema}
            for repo_id, ord_, id_, decided, vector in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "ord", "id", "decided_at", "vector"))):
                if (repo_id, ord_, id_) == last:
                    continue
                if held and (held[0][0] != repo_id or len(held) >= block):
                    yield emit()
                    held, seq = [], seq + 1
                last = (repo_id, ord_, id_)
                held.append((repo_id, id_, decided, vector))
        if held:
            yield emit()

    packs = dealt.mapInArrow(each, f"repo_id {repo}, seq long, ids array<{key}>, decided array<{when}>, matrix binary")
    return packs.withColumn("part", F.spark_partition_id())


def _codes(*lists: list) -> list[np.ndarray]:
    """Values as numbers in their order, -1 for null."""
    code = {v: k for k, v in enumerate(sorted({v for values in lists for v in values if v is not None}))}
    return [np.array([-1 if v is None else code[v] for v in values], dtype=np.int64) for values in lists]


def _edges(met: DataFrame, floor: float) -> DataFrame:
    """Of each pack and some active decisions, or itself: the similar pairs, as arrays side by side."""
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, others, decided, other_decided, places, x, y = (row.column(c)[0].as_py() for c in ("ids", "other_ids", "decided", "other_decided", "places", "matrix", "other_matrix"))
                left, right = np.frombuffer(x).reshape(len(ids), -1), np.frombuffer(y).reshape(len(others), -1)
                scores = np.round(left @ right.T, 6)
                good = scores >= floor
                if places is None:  # the pack itself: only what comes before
                    good = np.tril(good, -1)
                i, j = np.nonzero(good)
                met_, j = np.unique(j, return_inverse=True)
                mine, theirs = _codes(decided, other_decided)
                newer = np.where((mine[i] < 0) | (theirs[met_][j] < 0), -1, mine[i] > theirs[met_][j]).astype(np.int8)
                at = met_ if places is None else np.frombuffer(places, dtype=np.int64)[met_]
                made = [pa.array([v.tobytes()], pa.binary()) for v in (i.astype(np.int32), j.astype(np.int32), scores[good], newer, at.astype(np.int64))]
                names = pa.array([[others[m] for m in met_.tolist()]], row.schema.field("other_ids").type)
                mine = row.column("ids") if places is None else pa.array([None], names.type)
                yield pa.RecordBatch.from_arrays([row.column("repo_id"), pa.array([places is None]), mine, names, *made], names=["repo_id", "own", "ids", "other_ids", "i", "j", "scores", "newer", "places"])

    return met.mapInArrow(each, f"repo_id {kinds['repo_id']}, own boolean, ids {kinds['ids']}, other_ids {kinds['ids']}, i binary, j binary, scores binary, newer binary, places binary")


def _folded(edges: DataFrame) -> DataFrame:
    """(repo_id, id, by) of one pack of each repository, decided in order: each is linked with its nearest neighbour that is then active."""
    repo, key = edges.schema["repo_id"].dataType.simpleString(), edges.schema["ids"].dataType.elementType.simpleString()

    def each(table: pa.Table) -> pa.Table:
        repo_type, id_type = table.schema.field("repo_id").type, table.schema.field("ids").type.value_type
        ids, names, parts, met = [], [], [], 0
        for own, mine, others, *arrays in zip(*(table.column(c).to_pylist() for c in ("own", "ids", "other_ids", "i", "j", "scores", "newer", "places"))):
            i, j, scores, newer, places = (np.frombuffer(a, dtype=t) for a, t in zip(arrays, (np.int32, np.int32, np.float64, np.int8, np.int64)))
            # Others of the pack itself are told by their position, earlier ones by where they stand behind it.
            parts.append((i, places[j] if own else -1 - met - j, scores, newer, places[j] + (1 << 60) * own))
            if own:
                ids = mine
            else:
                names += others
                met += len(others)
        i, ref, scores, newer, places = (np.concatenate(c) for c in zip(*parts))
        ref = np.where(ref < 0, len(ids) - 1 - ref, ref)
        order = np.lexsort((places, -scores, i))
        i, ref, newer = i[order], ref[order], newer[order]
        starts = np.searchsorted(i, np.arange(len(ids) + 1))
        active = np.ones(len(ids) + met, dtype=bool)
        every, links = ids + names, []
        for k in range(len(ids)):
            near = ref[starts[k] : starts[k + 1]]
            open_ = active[near]
            if not len(near) or not open_[first := int(open_.argmax())] or newer[starts[k] + first] < 0:
                continue
            other = int(near[first])
            gone, by = (other, k) if newer[starts[k] + first] else (k, other)
            active[gone] = False
            links.append((every[gone], every[by]))
        owner = [table.column("repo_id")[0].as_py()] * len(links)
        return pa.table([pa.array(owner, repo_type), pa.array([x for x, _ in links], id_type), pa.array([y for _, y in links], id_type)], names=["repo_id", "id", "by"])

    return edges.groupBy("repo_id").applyInArrow(each, f"repo_id {repo}, id {key}, by {key}")


def _still(parts: DataFrame, linked: DataFrame, begin: int) -> DataFrame:
    """Parts of the active decisions without those that a round made inactive; a pack of that round is placed from ``begin``."""
    gone = linked.groupBy("repo_id").agg(F.collect_list("id").alias("gone"))  # at most a link for each decision of a pack
    met, names = parts.join(gone.hint("merge"), "repo_id", "left"), parts.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, decided, matrix, places, gone = (row.column(c)[0].as_py() for c in ("other_ids", "other_decided", "other_matrix", "places", "gone"))
                out = set(gone or ())
                at = np.array([x for x, id_ in enumerate(ids) if id_ not in out], dtype=np.int64)
                if not len(at):
                    continue
                where = begin + at if places is None else np.frombuffer(places, dtype=np.int64)[at]
                left = [pa.array([[values[x] for x in at.tolist()]], row.schema.field(c).type) for c, values in (("other_ids", ids), ("other_decided", decided))]
                kept = [np.frombuffer(matrix).reshape(len(ids), -1)[at].tobytes(), where.tobytes()]
                yield pa.RecordBatch.from_arrays([row.column("repo_id"), row.column("last"), *left, *(pa.array([v], pa.binary()) for v in kept)], names=names)

    return met.mapInArrow(each, parts.schema)


def supersede(decisions: DataFrame, floor: float = SETTINGS.supersede_floor, block: int = 2048) -> DataFrame:
    """Link each decision, in order of processing within its repository, to its nearest neighbour that is still active.

    Expects what ``neighbours`` expects. An earlier link changes who is active,
    so each repository is gone through in packs of ``block`` decisions, a pack of
    every repository a round: the pack is multiplied with those still active, a
    part of them in some task, and the pairs that reach ``floor`` are folded. A
    link makes one of two inactive, so few stay active where many are alike.
    Rounds are written to the shared folder; there are about as many as the
    largest repository has packs.
    """
    spark = decisions.sparkSession
    place = f"{shared_dir(spark)}/supersede-{uuid.uuid4().hex}"
    cut = keep(_packed(decisions, block), GROUP)
    own = Window.partitionBy("repo_id")
    slim = cut.select("repo_id", "part", "seq").withColumns({"nth": F.row_number().over(own.orderBy("part", "seq")), "last": F.count("*").over(own)})
    cut.join(slim.hint("merge"), ["repo_id", "part", "seq"]).select("repo_id", "last", "ids", "decided", "matrix", "nth").write.option("parquet.block.row.count.limit", GROUP).partitionBy("nth").parquet(f"{place}/packs")
    kind = {f.name: f.dataType.simpleString() for f in cut.schema}
    said = ", ".join(f"{c} {kind[c]}" for c in ("ids", "decided", "matrix"))
    packs = spark.read.schema(f"repo_id {kind['repo_id']}, last long, {said}, nth int").parquet(f"{place}/packs")
    links = spark.createDataFrame([], f"repo_id {kind['repo_id']}, id {decisions.schema['id'].dataType.simpleString()}, by {decisions.schema['id'].dataType.simpleString()}")
    active, rounds = None, slim.agg(F.max("nth")).first()[0] or 0
    for k in range(1, rounds + 1):
        pack = packs.filter(F.col("nth") == k).drop("nth")
        itself = pack.select("repo_id", "last", F.col("ids").alias("other_ids"), F.col("decided").alias("other_decided"), F.col("matrix").alias("other_matrix"), F.lit(None).cast("binary").alias("places"))
        met = pack.select("*", *(F.col(c).alias(f"other_{c}") for c in ("ids", "decided", "matrix")), F.lit(None).cast("binary").alias("places"))
        if active is not None:
            met = met.unionByName(pack.join(active.drop("last").hint("merge"), "repo_id"))
        _folded(_edges(met, floor)).write.parquet(f"{place}/links/round={k}")
        if k < rounds:
            linked = spark.read.schema(links.schema).parquet(f"{place}/links/round={k}")
            parts = itself if active is None else itself.unionByName(active)
            active = keep(_still(parts.filter(F.col("last") > k), linked, (k - 1) * block), GROUP)
    if rounds:
        links = spark.read.schema(links.schema).parquet(f"{place}/links").drop("round")
    return decisions.select("repo_id", "id").join(links.withColumnRenamed("by", "superseded_by"), ["repo_id", "id"], "left")


def supersede_once(decisions: DataFrame, floor: float) -> DataFrame:
    """Single pass: each decision's best earlier neighbour in its repository, and which one gives way."""
    best = F.min(F.struct((-F.col("score")).alias("less"), "other_place", "newer")).alias("best")
    found = neighbours(decisions, floor).groupBy("repo_id", "id").agg(best)
    newer, other = F.col("best.newer"), F.col("best.other_place.id")
    return found.select("repo_id", F.when(newer, other).otherwise(F.col("id")).alias("id"), F.when(newer, F.col("id")).otherwise(other).alias("superseded_by"), (-F.col("best.less")).alias("score"))


def chain(decisions: DataFrame) -> DataFrame:
    """Where each decision's chain of successors ends, and after how many: (id, latest, depth).

    Expects id and superseded_by; a successor that is absent ends the chain.
    Each round doubles the reach, so a chain of n takes log2(n) joins; rounds
    are written to the shared folder. Chains that run in a circle have no end:
    ``latest`` and ``depth`` are null.
    """
    spark = decisions.sparkSession
    place = f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}"
    there = decisions.select(F.col("id").alias("superseded_by"), F.lit(True).alias("known"))
    links = decisions.select("id", "superseded_by").join(there, "superseded_by", "left")
    reach = links.select("id", F.when(F.col("known"), F.col("superseded_by")).otherwise(F.col("id")).alias("latest"), F.coalesce(F.col("known").cast("long"), F.lit(0)).alias("depth"))
    reach.withColumn("left", F.col("depth")).write.parquet(f"{place}/0")
    now, k = spark.read.parquet(f"{place}/0"), 0
    total = now.count()
    while 1 << k <= total and now.filter("left > 0").limit(1).count():
        on = now.select(F.col("id").alias("latest"), F.col("latest").alias("further"), F.col("depth").alias("more"))
        k += 1
        ahead = now.join(on, "latest").select("id", F.col("further").alias("latest"), (F.col("depth") + F.col("more")).alias("depth"), F.col("more").alias("left"))
        ahead.write.parquet(f"{place}/{k}")
        now = spark.read.parquet(f"{place}/{k}")
    ended = F.col("depth") < total
    return now.select("id", F.when(ended, F.col("latest")).alias("latest"), F.when(ended, F.col("depth").cast("int")).alias("depth"))
