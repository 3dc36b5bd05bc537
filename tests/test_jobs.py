"""Job, chain, scope and reranking operators on small tables."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators import decisions, jobs, ranking, retrieval


def test_chain_ends_and_circles(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(40, None), (50, 51), (51, 50), (60, 50), (70, 999), (80, 80)]
    found = {r["id"]: (r["latest"], r["depth"]) for r in decisions.chain(spark.createDataFrame(links, "id long, superseded_by long")).collect()}
    assert all(found[k] == (40, 40 - k) for k in range(1, 41))
    assert found[70] == (70, 0)
    assert all(found[k] == (None, None) for k in (50, 51, 60, 80))
    assert decisions.chain(spark.createDataFrame([], "id long, superseded_by long")).count() == 0


def test_doc_run_cuts_the_file_that_crosses_the_budget(spark):
    rows = [
        (1, 1, "docs/decisions/a.md", "## A\nx\n## B\ny"), (1, 2, "docs/decisions/b.md", "## C\nx\n## D\ny"), (1, 3, "docs/decisions/c.md", "plain"),
        (1, 4, "docs/a.md", "plain"), (1, 5, "docs/decisions/.env.md", "plain"), (1, 6, "docs/decisions/0.md", "z" * 50), (2, 7, "adr-1.md", "plain"), (1, 8, "docs/decisions/d.md", None),
    ]
    files = spark.createDataFrame(rows, "repo_id long, id long, file_path string, content string")
    repos = spark.createDataFrame([(1, "https://example.org/r"), (2, None)], "repo_id long, https_base string")
    outcomes = {r["id"]: r["outcome"] for r in jobs.doc_files(files, repos, 40).collect()}
    assert outcomes == {1: "considered", 2: "considered", 3: "considered", 5: "secret", 6: "oversize", 7: "no base", 8: "considered"}
    run = jobs.doc_run(files, repos, 3, 40)
    assert [(r["id"], r["topic"]) for r in run.orderBy("nth").collect()] == [(1, "A"), (1, "B"), (2, "C")]
    stored = spark.createDataFrame([(1, 10, "doc", ["docs/decisions/a.md", "x"]), (1, 11, "pr", ["docs/decisions/a.md"]), (1, 12, "doc", ["docs/decisions/c.md"]), (2, 13, "doc", ["docs/decisions/a.md"])], "repo_id long, id long, source_type string, touched_paths array<string>")
    assert [r["id"] for r in jobs.replaced_by_run(stored, run).collect()] == [10]


def test_reranker_that_fails_keeps_the_order(spark):
    hits = spark.createDataFrame([(1, 10, 2), (1, 11, 5), (1, 12, 9), (2, 20, 1), (2, 21, 2)], "query_id long, id long, position int")
    answers = [(1, 0, 2.0, 0.9), (1, 1, 2.0, 5.0), (1, 2, 1.0, 0.95), (1, 3, 0.0, float("inf")), (1, 4, 7.0, 1.0), (1, 5, 0.5, 1.0)]
    ask = lambda head: spark.createDataFrame(answers, "query_id long, seq long, index double, score double")
    found = ranking.reranked(hits, ask).orderBy("query_id", "position").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(1, 11), (1, 12), (1, 10), (2, 20), (2, 21)]


def test_scoped_rows_refuse_queries_without_a_repository(spark):
    chunks = spark.createDataFrame([(1, "a", "f.ts", "", "alpha beta gamma"), (2, "b", "f.ts", "", "alpha beta gamma")], "id long, repo_id string, file_path string, symbol string, content string")
    queries = spark.createDataFrame([(1, "alpha beta gamma", "b")], "query_id long, query string, repo_id string")
    assert [r["id"] for r in retrieval.search(chunks, queries).collect()] == [2]
    with pytest.raises(ValueError):
        retrieval.search(chunks, queries.drop("repo_id"))


def test_breaker_probes_after_its_cooldown(spark):
    calls = [(1, 1, 0, 429), (1, 2, 10, 429), (1, 3, 20, 500), (1, 4, 120, 429), (1, 5, 130, 200), (1, 6, 240, 200), (1, 7, 250, 429)]
    rows = spark.createDataFrame(calls, "provider long, id long, at_ms long, status int")
    states = [r["state"] for r in jobs.breaker_states(rows, 2, 100).orderBy("id").collect()]
    assert states == ["closed", "closed", "open", "half-open", "open", "closed", "closed"]


def test_finished_keeps_messages_of_errors_alone(spark):
    work = spark.createDataFrame([(1, "queued", 0, 0, "old"), (2, "queued", 0, 0, None), (3, "queued", 1, 2, "m")], "id long, status string, latency_ms long, tokens long, message string")
    told = spark.createDataFrame([(1, "done", 5, None, "gone"), (2, "error", 6, 7, "bad")], "id long, status string, latency_ms long, tokens long, message string")
    found = [tuple(r) for r in jobs.finished(work, told).orderBy("id").select("id", "status", "latency_ms", "tokens", "message").collect()]
    assert found == [(1, "done", 5, 0, None), (2, "error", 6, 7, "bad"), (3, "queued", 1, 2, "m")]
    assert jobs.pending(work.withColumn("status", F.lit(None).cast("string"))).count() == 3


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def drained(spark, tmp_path, schema, made):
    """What a stream over the files of a folder writes when it is started anew from its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = made(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    out = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    out.format("parquet").start(f"{tmp_path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()


def test_deferred_pushes_are_kept_over_a_restart_and_flushed_once(spark, tmp_path):
    from datetime import datetime, timedelta

    from citeloom.streaming import pushes

    schema = "repo_id long, ref string, kind string, before string, after string, ord long, at timestamp"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    first = [(1, "main", "push", "A", "B", 1, at(0)), (1, "dev", "push", "B", "C", 2, at(1)), (2, "main", "push", "X", "Y", 3, at(0)), (3, "main", "ready", None, None, 4, at(1))]
    second = [(1, "main", "push", "C", "D", 5, at(2)), (1, None, "ready", None, None, 6, at(3)), (1, None, "ready", None, None, 7, at(4)), (2, None, "ready", None, None, 8, at(200)), (1, "main", "push", "E", "F", 9, at(5))]
    third = [(1, None, "ready", None, None, 10, at(201)), (3, "main", "push", "P", "Q", 11, at(202)), (3, None, "ready", None, None, 12, at(203))]
    want = {(1, "A", "D", 3), (3, "P", "Q", 1)}  # of 2 and then of 1 the range lapsed after seven days
    got = []
    for part in (first, second, third):
        feed(spark, f"{tmp_path}/in", part, schema)
        got = [tuple(r)[:4] for r in drained(spark, tmp_path, schema, pushes.deferred)]
    assert sorted(got) == sorted(want)
    batch = pushes.deferred(spark.createDataFrame(first + second + third, schema)).collect()
    assert sorted(tuple(r)[:4] for r in batch) == sorted(want)


def test_rate_limit_as_stream_and_batch_equals_a_loop(spark, tmp_path):
    import random

    from citeloom.streaming import pushes

    rng = random.Random(3)
    rows = sorted(((rng.randint(1, 5), i, rng.randint(0, 400) * 1000) for i in range(300)), key=lambda r: (r[2], r[1]))
    open_, want = {}, {}
    for c, i, at in rows:
        start, used = open_.get(c, (None, 0))
        start, used = (at, 1) if start is None or at >= start + 60_000 else (start, used + 1)
        open_[c] = (start, used)
        want[i] = (c, used, used <= 4)
    schema = "client long, id long, at_ms long"
    told = lambda rs: {r["id"]: (r["client"], r["nth"], r["allowed"]) for r in rs}
    assert told(pushes.rate_limited(spark.createDataFrame(rows, schema), 4, 60_000).collect()) == want
    for part in (rows[:100], rows[100:101], rows[101:]):
        feed(spark, f"{tmp_path}/in", part, schema)
        got = drained(spark, tmp_path, schema, lambda s: pushes.rate_limited(s, 4, 60_000, "1 hour"))
    assert told(got) == want and len(got) == len(want)
    assert pushes.rate_limited(spark.createDataFrame([], schema), 4, 60_000).count() == 0


def test_rate_limit_of_the_whole_table(spark):
    from citeloom.plans import catalog

    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "event_id", "unix_millis(cast(ts as timestamp)) as at")
    open_, want = {}, {}
    for c, i, at in sorted((tuple(r) for r in e.collect()), key=lambda r: (r[0], r[2], r[1])):
        start, used = open_.get(c, (None, 0))
        open_[c] = (at, 1) if start is None or at >= start + 86_400_000 else (start, used + 1)
        want[i] = (c, open_[c][1], open_[c][1] <= 10)
    assert {r["id"]: (r["client"], r["nth"], r["allowed"]) for r in catalog.queries()["stream_rate_limit"](spark, sf).collect()} == want


@pytest.mark.parametrize("lines, cases", [
    (["generated/"], {"generated/output.ts": True, "generated": False, "a/generated/b": True}),
    (["*.log", "!keep.log"], {"a.log": True, "x/keep.log": False, "KEEP.LOG": False, "x/b.LOG": True}),
    (["/root.txt", "docs/*.md"], {"root.txt": True, "a/root.txt": False, "docs/a.md": True, "docs/b/a.md": False, "x/docs/a.md": False}),
    (["**/tmp/**", "a/**/z"], {"tmp/x": True, "q/tmp/x/y": True, "a/z": True, "a/b/c/z": True, "a/b": False}),
    (["out/", "!out/keep"], {"out/keep": True}),
    (["out/*", "!out/keep"], {"out/keep": False, "out/other": True, "out/keep/x": False}),
    (["# note", "", "\\#real", "sp\\ ", "f[0-9]?.[!c]"], {"# note": False, "#real": True, "sp ": True, "f1x.h": True, "f1x.c": False, "fax.h": False}),
    (["a+b.(c)", "x*"], {"a+b.(c)": True, "aab.(c)": False, "xyz/k": True}),
])
def test_ignore_rules(spark, lines, cases):
    from pyspark.sql import functions as F

    from citeloom.functions import ignore

    frame = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r["p"]: r["x"] for r in frame.withColumn("x", ignore.is_ignored(F.col("p"), ignore.rules(lines))).collect()} == cases


def test_listed_files(spark, tmp_path):
    from citeloom.sources import events

    files = {
        ".gitignore": "*.tmp\nlocal/\n", "sub/.gitignore": "!b.tmp\n/own.txt\n", "a.tmp": "x", "sub/b.tmp": "x", "sub/own.txt": "x", "sub/deep/own.txt": "x", "local/c.txt": "x", "z.md": "é", "b in.ts": "x",
        "node_modules/m.js": "x", ".env2": "x", "src/env.ts": "x", ".envrc": "x", "db/drizzle/meta/0_snapshot.json": "x", "db/drizzle/sql/1.sql": "x", "x.PNG": "x", "bin.dat": "a\0b", "big.txt": "x" * 512_001, "fit.txt": "x" * 512_000,
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = [r["file_path"] for r in events.list_files(spark, str(tmp_path)).collect()]
    assert got == sorted([".envrc", ".gitignore", "sub/.gitignore", "sub/b.tmp", "sub/deep/own.txt", "z.md", "b in.ts", "src/env.ts", "fit.txt"])
    assert "z.md" not in [r["file_path"] for r in events.list_files(spark, str(tmp_path), ("*.md",)).collect()]


def test_history_log_as_batch_and_stream(spark, tmp_path):
    from citeloom.sources import files

    files.register(spark)
    sha = lambda c: c * 40
    log = lambda *rows: "\0".join("\0".join(r) for r in rows)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r1").write_text(log((sha("a"), "1", "one", "body\nmore"), ("\nbad", "2", "two", ""), ("\n" + sha("b"), "3", "é", "")))
    (tmp_path / "in" / "r2").write_text(log((sha("c"), "4", "x" * 3_000_000, "b"), (sha("d"), "5", "last")))
    (tmp_path / "in" / "r0").write_text("")
    want = [("r1", sha("a"), "one", "body\nmore"), ("r1", sha("b"), "é", ""), ("r2", sha("c"), "x" * 3_000_000, "b"), ("r2", sha("d"), "last", "")]
    read = spark.read.format("history_log")
    told = lambda rows: sorted((r["log"], r["sha"], r["subject"], r["body"]) for r in rows)
    assert told(read.load(f"{tmp_path}/in").collect()) == want
    assert told(read.option("limit", 1).load(f"{tmp_path}/in").collect()) == [want[0], want[2]]

    def run():
        out = spark.readStream.format("history_log").load(f"{tmp_path}/in").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        out.format("parquet").start(f"{tmp_path}/out").awaitTermination()
        return told(spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == want
    (tmp_path / "in" / "r3").write_text(log((sha("e"), "6", "new", "")))
    assert run() == [*want, ("r3", sha("e"), "new", "")]


def folded(rows, floor):
    """Supersession in order: (repo, id, ord, decided_at, kind, vector) rows to id -> superseded_by."""
    import numpy as np

    by = {r[1]: None for r in rows}
    for repo in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == repo), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(mine):
            if r[4] == "doc":
                continue
            near = [(-round(float(np.dot(r[5], o[5])), 6), k, o) for k, o in enumerate(mine[:i]) if o[4] != "doc" and by[o[1]] is None]
            near = [n for n in near if -n[0] >= floor]
            if near:
                other = min(near, key=lambda n: n[:2])[2]
                by[other[1] if r[3] > other[3] else r[1]] = r[1] if r[3] > other[3] else other[1]
    return by


@pytest.mark.parametrize("block", [4, 1024])
def test_supersession_in_rounds_equals_the_fold(spark, block, monkeypatch):
    import random

    rng = random.Random(block)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [(i % 3, i, rng.randint(0, 20), rng.randint(0, 9), rng.choice(["pr", "pr", "commit", "doc"]), unit([rng.gauss(0, 1) for _ in range(3)])) for i in range(90)]
    rows += [(7, 200 + i, i, i % 4, "pr", [1.0, 0.0, 0.0]) for i in range(6)]
    frame = spark.createDataFrame(rows, "repo_id long, id long, ord long, decided_at long, source_type string, vector array<double>")
    whole = decisions.neighbours
    monkeypatch.setattr(decisions, "neighbours", lambda d, f: whole(d, f, block))
    got = {r["id"]: r["superseded_by"] for r in decisions.supersede(frame, 0.9).collect()}
    assert got == folded(rows, 0.9) and sum(v is not None for v in got.values()) > 10
    assert decisions.supersede(frame.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("block", [3, 16])
def test_supersession_in_packs_takes_few_rounds(spark, block):
    import random

    rng = random.Random(block)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [(i % 2, i, rng.randint(0, 30), rng.randint(0, 9), rng.choice(["pr", "pr", "commit", "doc"]), unit([rng.gauss(0, 1) for _ in range(6)])) for i in range(60)]
    rows += [(7, 300 + i, i, 5 * i % 7, "pr", [1.0] + [0.0] * 5) for i in range(40)] + [(8, 500, 1, 1, "pr", [0.6, 0.8] + [0.0] * 4)]
    frame = spark.createDataFrame(rows, "repo_id long, id long, ord long, decided_at long, source_type string, vector array<double>")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"supersede-{block}", "")
    got = {r["id"]: r["superseded_by"] for r in decisions.supersede(frame.unionByName(frame.limit(5)), 0.6, block).collect()}
    spark.sparkContext.setJobGroup("", "")
    assert got == folded(rows, 0.6)
    assert len(tracker.getJobIdsForGroup(f"supersede-{block}")) < (200 if block == 3 else 60)  # 40 alike wait for each other in a row


def test_supersession_of_the_whole_table(spark):
    from citeloom.plans import catalog, history

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in history._vectors(spark, sf).select("repo_id", "id", "ord", "decided_at", "source_type", "vector").collect()]
    got = {r["id"]: r["superseded_by"] for r in catalog.queries()["join_supersede_ordered"](spark, sf).collect()}
    assert got == folded(rows, 0.25) and any(got.values())
