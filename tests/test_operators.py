"""Hand-worked cases and plain-loop comparisons of the library's own operators."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import policy, text
from citeloom.operators import typescript, chunking, decisions, metrics, ranking, sync
from citeloom.sources import events
from citeloom.streaming import pushes


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_identifier_parts(spark):
    got = one(spark, text.split_identifier(F.col("a")), a="verifyGitHubSignature")
    assert got == ["verifygithubsignature", "verify", "git", "hub", "signature"]
    assert one(spark, text.sparse_tokens(F.col("a")), a="max_HTTPServer 42 é") == ["max_httpserver", "max", "http", "server", "42"]


def test_fnv_known_value(spark):
    assert one(spark, text.fnv1a(F.col("a")), a="foobar") == 3214735720


@pytest.mark.parametrize("raw, want", [('"a b"', "a b"), ("'x", "'x"), ("`q`", "q"), ("  z ", "z"), ('"', '"')])
def test_lexical_query(spark, raw, want):
    assert one(spark, text.lexical_query(F.col("a")), a=raw) == want


@pytest.mark.parametrize("title, body, want", [
    ("chore: tidy", "", True), ("chore: tidy", "because of size", False), ("Merge x", "", True), ("Add cache", "", False), ("", "b", True), ("v1.2.3", "", True), ("renovate bot", "", True),
])
def test_trivial(spark, title, body, want):
    assert one(spark, policy.is_trivial(F.col("t"), F.col("b")), t=title, b=body) is want


@pytest.mark.parametrize("said, want", [("A rather than B", True), ("chose A over B", True), ("chose " + "x" * 200 + " over B", False), ("canvas", False), ("A vs. B", True), ("moreover", False)])
def test_contrast(spark, said, want):
    assert one(spark, policy.has_contrast(F.col("a")), a=said) is want


@pytest.mark.parametrize("path, want", [(".env", True), ("a/.env.local", True), (".env2", True), ("env.ts", False), (".envrc", False), ("k/id_rsa", True), ("a/b.pem", True), (".aws/credentials", True), (".environment", False)])
def test_secret_paths(spark, path, want):
    assert one(spark, policy.is_secret_path(F.col("a")), a=path) is want


def test_signature(spark):
    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    frame = spark.createDataFrame([("body", good), ("body", "sha256=0"), ("body", None)], "b string, h string")
    assert [r["x"] for r in frame.select(events.verify_signature("k")("b", "h").alias("x")).collect()] == [True, False, False]


def literal_cutoff(hits, limit, floor=0.5):
    """The staged cutoff as a plain loop."""
    key = lambda h: (-h["score"], h["id"])
    hits = sorted(hits, key=key)
    dual = [h for h in hits if h["d"] and h["s"]]
    if not dual:
        return [h["id"] for h in hits if h["score"] >= floor * hits[0]["score"]][:limit]
    least = floor * dual[0]["score"]
    strong = [h for h in dual if h["score"] >= least]
    half = max(1, limit // 2)
    first = sorted(strong[:half] + [h for h in hits if h["d"] and not h["s"] and h["score"] >= least], key=key)
    taken = {h["id"] for h in first} | {h["id"] for h in strong}
    near = [h for h in hits if h["id"] not in taken and (h["d"] and h["s"] or h["score"] >= 0.166667)]
    rank = lambda h: 0 if h["d"] and not h["s"] else 1 if h["d"] else 2
    return [h["id"] for h in first + sorted(near, key=lambda h: (rank(h), *key(h))) + strong[half:]][:limit]


def test_cutoff_against_loop(spark):
    rng, rows, want = random.Random(1), [], {}
    for q in range(60):
        hits = []
        for i in range(rng.randint(1, 14)):
            d = rng.random() < 0.6
            hits.append({"id": i, "score": round(sum(1 / (3 + rng.randint(0, 8)) for _ in range(1 + (d and rng.random() < 0.4))), 6), "d": d, "s": not d or rng.random() < 0.4})
        want[q] = literal_cutoff(hits, 6)
        rows += [(q, h["id"], h["score"], 0.5, int(h["d"]), int(h["s"])) for h in hits]
    fused = spark.createDataFrame(rows, "query_id int, id int, score double, evidence double, in_dense int, in_sparse int")
    got = {}
    for r in ranking.hybrid_cutoff(fused, 6).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == want


def test_diversify_against_loop(spark):
    rng, rows, want = random.Random(2), [], {}
    for q in range(40):
        paths = [f"p{rng.randint(0, 6)}{rng.choice(['.md', '.ts'])}" for _ in range(rng.randint(1, 12))]
        rows += [(q, i, p, i + 1) for i, p in enumerate(paths)]
        unique = list(dict.fromkeys(paths))
        cap, sources, out, late = 2, any(p.endswith(".ts") for p in unique), [], []
        for p in unique:
            if p.endswith(".md") and sources and sum(x.endswith(".md") for x in out) >= cap:
                late.append(p)
            else:
                out.append(p)
        want[q] = (out + late)[:5]
    hits = spark.createDataFrame(rows, "query_id int, id int, file_path string, position int")
    got = {}
    for r in ranking.diversify(hits, 5).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["file_path"])
    assert got == want


def literal_paragraphs(source):
    import re

    bounds = [0] + [m.end() for m in re.finditer(r"\n\s*\n", source)]
    out, group, cursor = [], 0, 0

    def flush(end):
        nonlocal group
        if end > group:
            if end - group <= 2000:
                out.append((group, end))
            else:
                for o in range(group, end, 1800):
                    out.append((o, min(o + 2000, end)))
                    if o + 2000 >= end:
                        break
            group = end

    for i, start in enumerate(bounds):
        end = bounds[i + 1] if i + 1 < len(bounds) else len(source)
        if cursor > group and end - group > 1800:
            flush(start)
        cursor = end
    flush(len(source))
    return out


def test_paragraphs_against_loop(spark):
    rng = random.Random(3)
    texts = ["", "a", "\n\n", "x" * 5000] + ["".join(rng.choice(["word " * rng.randint(1, 300), "\n\n", "\n", "\n \n", "é"]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    files = spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in enumerate(texts)], "id int, file_path string, content string")
    got = {}
    for r in chunking.paragraphs(files).orderBy("id", "byte_start", "byte_end").collect():
        got.setdefault(r["id"], []).append((r["byte_start"], r["byte_end"]))
        assert r["content"] == texts[r["id"]][r["byte_start"] : r["byte_end"]]
    assert got == {i: w for i, t in enumerate(texts) if (w := literal_paragraphs(t))}


def test_markdown_sections(spark):
    source = "lead\n# A #\nx\n```\n# no\n```\n## B\ny\n### C\n## D\n# E\n"
    files = spark.createDataFrame([(1, "a.md", source), (2, "b.md", "plain")], "id int, file_path string, content string")
    got = [(r["id"], r["symbol"], r["parent"]) for r in chunking.markdown(files).orderBy("id", "byte_start").collect()]
    assert got == [(1, None, None), (1, "A", None), (1, "B", "A"), (1, "C", "B"), (1, "D", "A"), (1, "E", None), (2, None, None)]


def test_code_symbols():
    python = "import os\n@dec\nclass A:\n    def f(self):\n        def g(): pass\n        return g\n\ndef h():\n    return 'é'\n"
    assert [(n, p) for n, p, _, _ in chunking.python_symbols(python)] == [("A", None), ("f", "A"), ("g", "A"), ("h", None)]
    script = "export interface P { a: string }\nexport function f(x: number) { return { x }; }\nexport class K {\n  run(a: string): void { if (a) { go(a); } }\n  stop() {}\n}\nexport const arrow = (a: number) => a + 1;\n"
    found = typescript.symbols(script)
    assert [(n, p) for n, p, _, _ in found] == [("P", None), ("f", None), ("K", None), ("run", "K"), ("stop", "K"), ("arrow", None)]
    assert script[found[-1][2] : found[-1][3]] == "(a: number) => a + 1"
    assert script[found[1][2] : found[1][3]].startswith("export function f")


def test_doc_sections(spark):
    files = spark.createDataFrame([(1, "docs/ADR-1.md", "intro\n## One ##\nwhy\n## Two\nbecause"), (2, "x/SAFETY.md", "all of it")], "id int, file_path string, content string")
    got = [(r["id"], r["topic"], r["start_line"]) for r in chunking.doc_sections(files).orderBy("id", "start_line").collect()]
    assert got == [(1, "One", 2), (1, "Two", 4), (2, "SAFETY", 1)]


@pytest.mark.parametrize("raw, want", [
    ('Here: {"a": "}"} tail', '{"a": "}"}'), ("```json\n[1, [2]]\n```", "[1, [2]]"), ("none", "none"), ('{"a": 1', '{"a": 1'), ('x ["\\"]"] y', '["\\"]"]'),
])
def test_first_json(raw, want):
    assert decisions.balanced(raw) == want


def test_parsed(spark):
    rows = [('{"decisions":[{"topic":"t","summary":"s","confidence":"0.7"}]}',), ('[{"topic":"t","summary":"s","confidence":2}]',), ("{broken",)]
    got = [(r["valid"], r["decisions"]) for r in decisions.parsed(spark.createDataFrame(rows, "raw string")).collect()]
    assert [v for v, _ in got] == [True, False, False] and got[0][1][0]["confidence"] == 0.7 and got[0][1][0]["alternatives"] == []


def test_supersede_in_order(spark):
    rows = [(1, 1, 1, 10, "pr", [1.0, 0.0]), (1, 2, 2, 20, "pr", [1.0, 0.0]), (1, 3, 3, 15, "pr", [1.0, 0.0]), (1, 4, 4, 99, "doc", [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "repo_id long, id long, ord long, decided_at long, source_type string, vector array<double>")
    got = {r["id"]: r["superseded_by"] for r in decisions.supersede(frame, 0.75).collect()}
    assert got == {1: 2, 2: None, 3: 2, 4: None}


def test_chunk_plan(spark):
    old = spark.createDataFrame([("f", "h1", 1), ("f", "h1", 2), ("f", "h2", 3)], "file_path string, content_hash string, id int")
    new = spark.createDataFrame([("f", "h1", 10), ("f", "h3", 11)], "file_path string, content_hash string, id int")
    got = {(r["content_hash"], r["id"], r["action"]) for r in sync.plan_chunk_sync(old, new).collect()}
    assert got == {("h1", 1, "keep"), ("h1", 2, "delete"), ("h2", 3, "delete"), ("h3", 11, "insert")}


def test_rate_limit_windows_begin_at_first_request(spark):
    rows = [(1, i, t) for i, t in enumerate((0, 10, 59, 60, 61, 130))] + [(2, 9, 5)]
    frame = spark.createDataFrame(rows, "client long, id long, at_ms long")
    got = {(r["client"], r["id"]): (r["nth"], r["allowed"]) for r in pushes.rate_limited(frame, 2, 60).collect()}
    assert got == {(1, 0): (1, True), (1, 1): (2, True), (1, 2): (3, False), (1, 3): (1, True), (1, 4): (2, True), (1, 5): (1, True), (2, 9): (1, True)}


def test_breaker(spark):
    rows = [("p", i, i, s) for i, s in enumerate((429, 500, 429, 200, 429, 429, 429))]
    got = [r["id"] for r in metrics.breaker_trips(spark.createDataFrame(rows, "provider string, id int, ts int, status int")).orderBy("id").collect()]
    assert got == [2, 5, 6]


def test_log_records(spark):
    sha = "a" * 40
    got = one(spark, events.parse_log(F.concat_ws("\0", F.lit(sha), F.lit("t"), F.lit("s"), F.lit("b"), F.lit("bad"), F.lit("t"), F.lit("s"), F.lit("b"))), a="")
    assert [r["subject"] for r in got] == ["s"] and got[0]["sha"] == sha


def test_catalog_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain_windows(s, e):
    out = []
    for o in range(s, e, 1800):
        out.append((o, min(o + 2000, e)))
        if o + 2000 >= e:
            break
    return out


def plain_markdown(source):
    """(symbol, parent, start, end) of sections by a loop over lines with a stack of headings."""
    import re

    found, stack, offset, fenced = [], [], 0, False
    for line in source.split("\n"):
        if re.match(r"(`{3,}|~{3,})", line.lstrip()):
            fenced = not fenced
        elif not fenced and (m := re.fullmatch(r"(#{1,6})[ \t]+([^\n]+?)[ \t]*", line)) and (title := re.sub(r"[ \t]+#+[ \t]*$", "", m[2]).strip()):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            found.append((title, stack[-1][1] if stack else None, offset))
            stack.append((len(m[1]), title))
        offset += len(line) + 1
    ends = [f[2] for f in found[1:]] + [len(source)]
    lead = [(None, None, 0, found[0][2] if found else len(source))]
    return [(t, p, a, b) for t, p, s, e in lead + [(t, p, s, e) for (t, p, s), e in zip(found, ends)] for a, b in plain_windows(s, e)]


def test_files_of_the_whole_table_against_loops(spark):
    from citeloom.plans import base, catalog

    sf = "/root/testdata/sf0.01"
    want = set()
    for r in base.files(spark, sf).collect():
        ext, text = r["file_path"].rsplit(".", 1)[-1], r["content"]
        if text is None or "\0" in text:
            continue
        if ext == "md":
            want |= {(r["id"], *c, "markdown") for c in plain_markdown(text)}
        elif ext in ("txt", "rst"):
            want |= {(r["id"], None, None, a, b, "text") for a, b in literal_paragraphs(text)}
        else:
            want |= {(r["id"], None, None, a, b, f"unknown(.{ext})") for a, b in plain_windows(0, len(text))}
    rows = catalog.queries()["chunk_files"](spark, sf).collect()
    assert {(r["id"], r["symbol"], r["parent"], r["byte_start"], r["byte_end"], r["language"]) for r in rows} == want and len(rows) == len(want)


def test_doc_sections_of_the_whole_table_against_a_loop(spark):
    import re

    from citeloom.plans import catalog

    sf = "/root/testdata/sf0.01"
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        lines = re.split(r"\r?\n", re.sub(r"\. ([A-Z])", ".\n## \\1", r["text"] or ""))
        parts, title, start = [], None, 0
        held = []
        for n, line in enumerate(lines):
            m = re.fullmatch(r"##[ \t]+([^\n]+?)[ \t]*", line)
            name = re.sub(r"[ \t]+#+[ \t]*$", "", m[1]).strip() if m else ""
            if name:
                parts.append((title, start, held))
                title, start, held = name, n, []
            held.append(line)
        parts.append((title, start, held))
        if len(parts) > 1:
            parts = parts[1:]
        kept = [(t, s, "\n".join(h).strip()) for t, s, h in parts]
        kept = [k for k in kept if k[2]][:20]
        want |= {(r["doc_id"], (t or str(r["doc_id"]))[:500], s + 1) for t, s, _ in kept}
    rows = catalog.queries()["chunk_doc_sections"](spark, sf).collect()
    got = {(r["id"], r["topic"], r["start_line"]) for r in rows}
    assert got == want and len(rows) == len(want)
