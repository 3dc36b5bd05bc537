"""The stored index, the sink and the providers against plain loops."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators import decisions, index, providers, ranking, retrieval
from citeloom.sources import vectors

WORDS = ["alpha", "betaGamma", "get_user", "HTTPServer", "x1", "delta", "7", "eta", "theta", "iota", "kappa", "lambda_x"]


def corpus(rng, n):
    return [(i, f"r{i % 3}", f"src/f{i}.ts", None, " ".join(rng.choices(WORDS[: 3 + i % 10], k=rng.randint(0, 30)))) for i in range(n)]


COLUMNS = "id long, repo_id string, file_path string, symbol string, content string"


def plainly(rows, queries, limit, floor, embed=index.bag):
    """Scores of all pairs, and the best of each query and channel."""
    counts = [index.terms(r[4]) for r in rows]
    df = {t: sum(t in c for c in counts) for c in counts for t in c}
    found = set()
    for q, repo, asked in queries:
        v = embed([asked])[0]
        dense, sparse = [], []
        for r, c in zip(rows, counts):
            if repo is not None and r[1] != repo:
                continue
            score = round(float(np.dot(embed([r[4]])[0], v)), 6)
            if score >= floor:
                dense.append((-score, r[0]))
            total = 0.0
            for t, n in index.terms(asked).items():
                if t in c:
                    w = c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * max(sum(c.values()), 1) / 180))
                    total += n * w * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5))
            if total > 0:
                sparse.append((-round(total, 6), r[0]))
        found |= {(q, i, "dense", -s) for s, i in sorted(dense)[:limit]} | {(q, i, "sparse", -s) for s, i in sorted(sparse)[:limit]}
    return found


def best(frame, limit):
    frame = frame.withColumn("score", F.round("score", 6))
    out = set()
    for channel in ("dense", "sparse"):
        out |= {(r["query_id"], r["id"], channel, r["score"]) for r in ranking.ranked(frame.filter(F.col("channel") == channel), channel, limit).collect()}
    return out


@pytest.mark.parametrize("block, scoped", [(3, False), (7, True), (2048, True)])
def test_index_equals_all_pairs(spark, block, scoped):
    rng = random.Random(block)
    rows = corpus(rng, 120)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    frame = frame if scoped else frame.drop("repo_id")
    queries = [(k, f"r{k % 4}" if scoped else None, " ".join(rng.choices(WORDS, k=4))) for k in range(12)] + [(90, "r1" if scoped else None, ""), (91, "r1" if scoped else None, "nothing here")]
    asked = spark.createDataFrame(queries, "query_id int, repo_id string, query string")
    asked = asked if scoped else asked.drop("repo_id")
    built = index.pack(index.encode(frame), block)
    assert best(index.nearest(built, asked, 5, 0.2), 5) == plainly(rows, queries, 5, 0.2)
    assert index.nearest(index.pack(index.encode(frame.limit(0))), asked, 5, 0.2).count() == 0
    assert index.nearest(built, asked.limit(0), 5, 0.2).count() == 0


def test_encode_equals_the_column_functions(spark):
    rows = corpus(random.Random(1), 40) + [(99, "r", "p", None, "ÀlphaBeta İx_Ünit K2 __a a_b_C HTTPServerID 12ab snake__Case")]
    frame = spark.createDataFrame(rows, COLUMNS).drop("repo_id")
    got = index.encode(frame)
    bags = frame.select("id", text.bag_vector(F.col("content")).alias("bag"))
    for r in got.join(bags, "id").collect():
        assert np.allclose(r["vector"], r["bag"])
    flat = lambda df: {(r["id"], r["term"], round(r["weight"], 9)) for r in df.collect()}
    mine = got.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("id", F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"))
    assert flat(mine) == flat(retrieval.postings(frame))


def test_blocks_that_cannot_win_are_skipped(spark):
    rows = [(i, f"f{i}", None, ("rare " * 5 if i < 10 else "common rare " + "filler " * 60)) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, file_path string, symbol string, content string").coalesce(1)
    built, asked = index.pack(index.encode(frame), 20), spark.createDataFrame([(1, "rare")], "query_id int, query string")
    r = index.skipped(built, asked, 5).first()
    assert r["pairs"] == 20 and r["skipped"] >= 15
    assert {x["id"] for x in ranking.ranked(index.nearest(built, asked, 5, 0.0, channels=("sparse",)), "sparse", 5).collect()} == {0, 1, 2, 3, 4}


def test_embedder_and_vectors_passed_in(spark):
    def flat(texts):
        return [[float(len(t)), 1.0, 0.0] for t in texts]

    rows = spark.createDataFrame([(i, f"f{i}.ts", None, "x" * i) for i in range(1, 70)], "id long, file_path string, symbol string, content string")
    asked = spark.createDataFrame([(1, "xyz", [1.0, 0.0, 0.0])], "query_id int, query string, vector array<double>")
    built = index.build(rows, flat)
    top = ranking.ranked(index.nearest(built, asked, 3, 0.0, channels=("dense",)), "dense", 3)
    assert [(r["id"], r["score"]) for r in top.orderBy("rank").collect()] == [(69, 69.0), (68, 68.0), (67, 67.0)]
    found = retrieval.search(rows, asked, 2, lexical=False, index=built, mode="dense").orderBy("position").collect()
    assert [(r["id"], r["score"], r["evidence"]) for r in found] == [(69, 69.0, 69.0), (68, 68.0, 68.0)]
    for bad in (lambda ts: [[1.0]] * (len(ts) + 1), lambda ts: [[]] * len(ts), lambda ts: [[math.nan]] * len(ts)):
        with pytest.raises(Exception, match="embedded"):
            index.encode(rows, bad).collect()


def test_lexical_without_a_cross_join(spark):
    rng = random.Random(6)
    rows = [(i, f"{'SrC' if i % 2 else 'lib'}/Dir{i % 7}/file{i}.ts", rng.choice([None, "", "getUser", "User", "é", f"sym{i}"]), "body user") for i in range(60)]
    chunks = spark.createDataFrame(rows, "id long, file_path string, symbol string, content string")
    asked = ["getUser", "user", "r", "/", "dir3/", "FILE1", "é", "", "zzz", "file12.ts", "ts", "lib/Dir0/file0.ts", "'User'"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    frame = retrieval.lexical_hits(chunks, queries, 50)
    got = {(r["query_id"], r["id"]) for r in frame.collect()}
    plain = queries.select("query_id", text.lexical_query(F.col("query")).alias("q")).crossJoin(chunks)
    kind = text.lexical_match(F.col("q"), F.col("file_path"), F.col("symbol"), F.col("content"))
    held = F.contains(F.lower("symbol"), F.lower("q")) | F.contains(F.lower("file_path"), F.lower("q"))
    want = {(r["query_id"], r["id"]) for r in plain.filter(held & kind.isNotNull()).collect()}
    counts = {q: sum(w[0] == q for w in want) for q, _ in want}
    assert {w for w in want if counts[w[0]] <= 50} == {g for g in got if counts[g[0]] <= 50} and len(got) > 30
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "NestedLoop" not in frame._jdf.queryExecution().sparkPlan().toString()


def test_collection_modes_and_writes(spark, tmp_path):
    path = f"{tmp_path}/points"
    rows = spark.createDataFrame(corpus(random.Random(2), 30), COLUMNS)
    points = index.encode(rows).select("repo_id", "id", "vector", "terms", "weights")
    assert vectors.mode(spark, path) == "missing" and vectors.prepare(spark, path, "r0") == "created"
    with pytest.raises(ValueError):
        vectors.prepare(spark, path, " ")
    vectors.replace_repositories(points, path)
    count = lambda: {r["repo_id"]: r["count"] for r in spark.read.parquet(path).groupBy("repo_id").count().collect()}
    assert vectors.mode(spark, path) == "hybrid" and count() == {"r0": 10, "r1": 10, "r2": 10}
    vectors.replace_repositories(points.filter("repo_id = 'r1' and id < 10"), path)
    assert count() == {"r0": 10, "r1": 3, "r2": 10}
    vectors.upsert(points.filter("repo_id = 'r1' and id < 20"), path)
    vectors.upsert(points.filter("repo_id = 'r1' and id > 20").limit(2), path, "other")
    assert count() == {"r0": 10, "r1": 9, "r2": 10}
    vectors.delete_ids(spark, path, spark.createDataFrame([(0,), (1,)], "id long"))
    assert count() == {"r0": 9, "r1": 8, "r2": 10}
    assert tuple(vectors.homogeneity(spark.read.parquet(path), sample=256).first()) == (27, 0, 2)
    assert vectors.prepare(spark, path, "r2") == "cleared" and count() == {"r0": 9, "r1": 8}
    asked = spark.createDataFrame([(1, "r0", "alpha")], "query_id int, repo_id string, query string")
    assert index.nearest(index.pack(spark.read.parquet(path)), asked, 5, 0.0).count() > 0
    with pytest.raises(Exception, match="empty vector"):
        vectors.replace_repositories(points.withColumn("vector", F.array().cast("array<double>")), path)
    old = f"{tmp_path}/old"
    points.drop("terms", "weights").write.partitionBy("repo_id").parquet(old)
    assert vectors.mode(spark, old) == "legacy" and vectors.prepare(spark, old, "r0") == "recreated" and vectors.mode(spark, old) == "missing"


def said(answer):
    def call(*request, key=None):
        if isinstance(answer, Exception):
            raise answer
        return answer

    return call


def test_fail_over_in_order():
    now = [0.0]
    first, second = providers.Provider("a", "m1", said(providers.Refused(429)), 1), providers.Provider("b", "m2", said(("yes", 3)), 2)
    gate = providers.Gateway((second, first, providers.Provider("c", "m0", said("no"), 0, enabled=False)), clock=lambda: now[0])
    assert gate.primary() == "m1"
    for _ in range(3):
        answer, p, _ = gate.ask("s", "u")
        assert answer == ("yes", 3) and p.id == "b"
    assert [u["provider"] for u in gate.usage] == ["a", "b", "a", "b", "b"]  # two refusals opened the first one's breaker
    now[0] = 301.0
    gate.ask("s", "u")
    assert [u["provider"] for u in gate.usage][-2:] == ["a", "b"]  # half open, one probe
    keyless = providers.Provider("k", "m", said("x"), 0, key=lambda: "")
    assert providers.Gateway((keyless, second)).ask("s", "u")[1].id == "b"
    with pytest.raises(LookupError, match="no key"):
        providers.Gateway((keyless,)).ask("s", "u")
    hard = providers.Provider("h", "m", said(providers.Refused(401)), 0)
    assert providers.Gateway((hard, second)).ask("s", "u")[1].id == "b"
    with pytest.raises(providers.Refused):
        providers.Gateway((hard,)).ask("s", "u")
    late = providers.Provider("l", "m", lambda *_: time.sleep(2), 0)
    gate = providers.Gateway((late, second), seconds=0.2)
    assert gate.ask("s", "u")[1].id == "b" and "0.2 seconds" in gate.usage[0]["error"]
    assert providers.Gateway((first, second), open_for={"a": 10}).ask("s", "u")[1].id == "b"


def test_answers_are_those_of_asking_one_by_one():
    import threading

    threads = []

    def first(n):
        threads.append(threading.get_ident())
        if n % 3 == 0:
            raise providers.Refused(500)
        if n in (4, 11):
            time.sleep(1.5)
        return f"a{n}"

    def second(n):
        if n == 6:
            raise providers.Refused(400, "no")
        return f"b{n}"

    gate = providers.Gateway((providers.Provider("a", "m", first, 0), providers.Provider("b", "m", second, 1)), seconds=0.3)
    found = gate.answers([(n,) for n in range(300)])
    want = [f"b{n}" if n % 3 == 0 or n in (4, 11) else f"a{n}" for n in range(300)]
    assert [None if isinstance(f, Exception) else f[0] for f in found] == [None if n == 6 else w for n, w in enumerate(want)]
    assert str(found[6]) == "no" and [u["error"] for u in gate.usage if "seconds" in (u["error"] or "")] == ["no answer in 0.3 seconds"] * 2
    assert len(set(threads)) <= 3  # a late call keeps its thread, all others share one
    assert gate.answers([]) == []

    def ends(n):
        raise SystemExit

    with pytest.raises(SystemExit):
        providers.Gateway((providers.Provider("a", "m", ends),)).answers([(1,)])


def test_answers_are_parsed_and_judged_once(spark):
    from citeloom.plans import catalog

    plan = catalog.queries()["decide_extract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Python" not in plan and "InArrow" not in plan


def test_sound_json_ends_where_its_brackets_do(monkeypatch):
    texts = ['{"a": "]}"} tail }', 'so: [1, {"b": "\\"["}] x', "{broken", '{"a": [}]} y', '{"a": NaN} z', "[" * 30_000 + "]" * 30_000 + "]", '```json\n{"a": {}}\n```', "none", '{"a": "\n"} b', '[1} 2]', '{"a": ' + "9" * 6000 + "} c"]
    quick = [decisions.balanced(t) for t in texts]
    monkeypatch.setattr(decisions._JSON, "raw_decode", lambda *_: float("no"))
    assert quick == [decisions.balanced(t) for t in texts] and quick[0] == '{"a": "]}"}'


def test_search_by_a_gateway_and_a_reranker_that_fails(spark):
    rows = spark.createDataFrame([(i, f"f{i}.ts", None, "alpha " * (i + 1) + "beta") for i in range(6)], "id long, file_path string, symbol string, content string")
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id int, query string")
    gate = providers.Gateway((providers.Provider("bad", "m", said(providers.Refused(500)), 0), providers.Provider("good", "m", index.bag, 1)))
    plain = retrieval.search(rows, asked, 3, lexical=False)
    order = lambda df: [r["id"] for r in df.orderBy("position").collect()]
    assert order(retrieval.search(rows, asked, 3, lexical=False, embed=gate.embed)) == order(plain)
    content, query = F.col("content"), F.lit("alpha beta")

    def broken(q, texts):
        raise RuntimeError("down")

    for call in (broken, lambda q, texts: time.sleep(3), lambda q, texts: [("x", 1.0)]):
        assert order(retrieval.search(rows, asked, 3, lexical=False, rerank=providers.reranker(call, query, content, 0.3))) == order(plain)
    backward = lambda q, texts: [(k, float(k)) for k in range(len(texts))]
    assert order(retrieval.search(rows, asked, 6, lexical=False, rerank=providers.reranker(backward, query, content))) == order(retrieval.search(rows, asked, 6, lexical=False))[::-1]


def test_open_breakers_from_a_log(spark):
    log = [("a", 1, 0, 429), ("a", 2, 10, 429), ("b", 3, 0, 429), ("b", 4, 5, 429), ("b", 5, 9, 200), ("c", 6, 1, 429), ("d", 7, 0, 200), ("d", 8, 1, 429), ("d", 9, 2, 500), ("d", 10, 3, 429)]
    assert providers.still_open(spark.createDataFrame(log, "provider string, id long, at_ms long, status int"), 10_000) == {"a": 290.01, "d": 290.003}


def test_suites_are_read_and_checked(spark, tmp_path):
    import json

    from citeloom.operators import metrics
    from citeloom.sources import suites

    cases = [
        {"id": "a", "tool": "search_codebase", "query": "q", "expect": {"anyOfPathIncludes": ["src/x"]}},
        {"id": "b", "tool": "search_codebase", "query": "q", "gate": "soft", "expect": {"expectEmpty": True}},
        {"id": "c", "tool": "find_decision", "query": "q", "expect": {"topicOrSummaryIncludesAny": ["why"], "maxCount": 2}},
    ]

    def read(suite):
        (tmp_path / "s.json").write_text(json.dumps(suite, indent=1))
        return suites.replay(spark, f"{tmp_path}/s.json")

    got = read({"version": 1, "description": "d", "cases": cases})
    assert [(r["id"], r["gate"], r["hit_at"], r["citation"]) for r in got.orderBy("nth").collect()] == [("a", "hard", 3, True), ("b", "soft", 3, True), ("c", "hard", 3, True)]
    hits = spark.createDataFrame([("a", 4, "src/x.ts", None), ("b", 1, "y", None)], "id string, position int, file_path string, symbol string")
    passed = suites.searched(got, hits)
    assert {r["id"]: r["passed"] for r in passed.collect()} == {"a": False, "b": False}
    assert tuple(metrics.replay(passed).first()) == (1, 1, False)
    assert {r["id"] for r in suites.searched(got, hits.withColumn("position", F.col("position") - 1).filter("id = 'a'")).filter("passed").collect()} == {"a", "b"}
    for bad in ({"version": 2, "cases": cases}, {"version": 1, "cases": []}, {"version": 1, "cases": [cases[0] | {"tool": "other"}]}, {"version": 1, "cases": [cases[0] | {"expect": {}}]}, {"version": 1, "cases": [cases[2] | {"expect": {"topicOrSummaryIncludesAny": ["x"], "maxCount": 99}}]}):
        with pytest.raises(Exception, match="suite refused"):
            read(bad).collect()


def test_one_channel_is_enough_where_asked(spark):
    fused = spark.createDataFrame([(1, 1, 0.5, 0.1, 1, 0), (1, 2, 0.3, 0.0, 0, 1), (1, 3, 0.2, 0.1, 1, 1)], "query_id int, id int, score double, evidence double, in_dense int, in_sparse int")
    assert [r["id"] for r in ranking.hybrid_cutoff(fused, 5, min_channels=1).orderBy("position").collect()] == [1, 2]


def test_cues_of_a_contrast_in_one_pass(spark):
    from citeloom.functions import policy

    rng = random.Random(5)
    parts = [" ", "\n", " ", "﻿", "vs", "vs.", "Versus", "chose", "over", "rather", "than", "instead of", "rejected", "é", "x", "_", "not using", "prefer", "preferred", "y" * 79, "."]
    texts = [("".join(rng.choices(parts, k=rng.randint(0, 6))),) for _ in range(4000)] + [(None,)]
    each = policy._any(text.trimmed(F.col("t")), policy.CONTRAST)
    rows = spark.createDataFrame(texts, "t string").select("t", policy.has_contrast(F.col("t")).alias("got"), each.alias("want")).collect()
    assert [r["t"] for r in rows if r["got"] != r["want"]] == [] and 500 < sum(bool(r["got"]) for r in rows) < 3500


def test_few_blocks_are_held_at_once(spark, monkeypatch):
    """Blocks that compress well fill a row group many times over, and a reader holds the rows of one."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(index, "BLOCK", 3)
    rows = spark.range(600).select("id", F.lit("alpha beta").alias("content"), F.lit("f.ts").alias("file_path"))
    stored = index.build(rows)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored.inputFiles()]
    assert sum(m.num_rows for m in files) >= 200 and max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) <= index.GROUP
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    found = retrieval.hybrid(stored, asked, 10, 0.1, 5)
    assert [r["id"] for r in found.orderBy("position").collect()][:2] == [0, 1] and found.count() == 5
    assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString()  # the blocks were read once, for both channels
