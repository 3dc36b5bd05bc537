"""Conversation repair, spelling variants and decontamination against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from citeloom.llm import conversation, decontaminate, registry, spelling

SF = "/root/testdata/sf0.01"


# op11
def harmed(rows):
    """Rows after damage, in order, by conversation; every original id is there."""
    found = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out = found.setdefault(c, [])
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], r[2])
    return {c: sorted(out, key=order) for c, out in found.items()}


def plainly(rows):
    """The contract of the query, by a plain recursion over (row, roles so far)."""
    blank = duplicate = truncated = illegal = 0
    kinds, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        if not bare:
            kinds.append("x")
            blank += 1
        elif (role, text) in seen:
            kinds.append("x")
            duplicate += 1
        else:
            late = bare[-1] not in ".!?"
            truncated += late
            kinds.append("t" if late else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, place, put):
        options = [(0, "", ())] if i == len(rows) and place in ("", "a") else []
        if i < len(rows):
            late = kinds[i] == "t"
            todo = [("D", 3, place, None)]
            if kinds[i] != "x":
                if (place, initials[i]) in grammar:
                    todo.append(("K", late, grammar[place, initials[i]], rows[i][1]))
                todo += [("R", 2 + late, grammar[place, r[0]], r) for r in ("user", "assistant") if (place, r[0]) in grammar]
            for letter, cost, to, role in todo:
                c, audit, lines = best(i + 1, to, 0)
                options.append((c + cost, letter + audit, ((f"{role}:{rows[i][2]}",) if role is not None else ()) + lines))
        if put < 4:
            for r in ("user", "assistant"):
                if (place, r[0]) in grammar:
                    c, audit, lines = best(i, grammar[place, r[0]], put + 1)
                    options.append((c + 2, "I" + audit, (f"{r}:",) + lines))
        return min(options, default=(1 << 20, "", ()))

    cost, audit, lines = best(0, "", 0)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def talk(rng, n):
    roles = ["user", "assistant", "system", "tool", "", None, "usher", "S"]
    texts = ["Yes.", "No", "Why? ", "", " \n", None, "é.", "a.b", "Stop!\t", "x" * 3000]
    rows = [(c, rng.choice([None, *range(-2, n)]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, n))]
    return rows + [(None, None, None, None), (None, 3, "user", "Q?"), (None, 4, "assistant", "A.")] + [(99, 7, "user", "same")] * 9


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_repair_equals_recursion(spark, most):
    rows = talk(random.Random(most), 7)
    frame = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversation.repair(frame, most=most).collect()}
    want = {c: plainly(rs) for c, rs in harmed(rows).items()}
    assert got == want
    lines = {}
    for r in conversation.repair(frame, most=most, repaired=True).orderBy("conv_id", "nth").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
    assert conversation.repair(frame.limit(0)).count() == 0


def test_repair_by_trying_everything():
    """Every way to edit short conversations, tried out."""
    shape = re.compile(r"(s?(ua)+)?")
    rng = random.Random(8)
    for _ in range(25):
        symbols = bytes(rng.choice(range(1, 10)) for _ in range(rng.randint(0, 3)))
        best = None
        for puts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(symbols) + 1):
            for edits in itertools.product("DKua", repeat=len(symbols)):
                out, audit, cost = puts[0], "I" * len(puts[0]), 2 * len(puts[0])
                for s, e, p in zip(symbols, edits, puts[1:]):
                    cost += 3 if e == "D" else s % 2 + (2 if e in "ua" else 0)
                    if e != "D" and s == 1:
                        cost += 1000
                    out += "" if e == "D" else "sua-"[s // 2 - 1] if e == "K" else e
                    audit += e if e in "DK" else "R"
                    out, audit, cost = out + p, audit + "I" * len(p), cost + 2 * len(p)
                if shape.fullmatch(out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        vectors = conversation.tables()[0]
        to, cost = conversation.effect(symbols)
        audit, _, place = conversation.traced(symbols, 0, 0)
        assert (cost[0] + vectors[to[0]][0], audit + conversation.ending(place)[0]) == best


def test_repair_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in registry.op11_conversation_repair(spark, SF).collect()}
    assert got == {c: plainly(rs) for c, rs in harmed(rows).items()}


# op12
def edits_of(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return found - {word}


def variants(docs, least=6, often=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    letters = sorted({c for w in words for c in w})
    near = {w: [v for v in edits_of(w, letters) if v in words] for w in words}
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def grouped(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(12)
    base = ["".join(rng.choices("abcdeé÷", k=rng.randint(5, 9))) for _ in range(25)] + ["Zebras", "l" * 47, "ab" * 24, "m" * 400]
    pool = []
    for w in base:
        pool += [w] * rng.choice([6, 30, 150])
        for v in rng.sample(sorted(edits_of(w, "abé")), 4):
            pool += [v] * rng.choice([5, 6, 30])
    pool += ["grapple"] * 6 + ["grappla"] * 40 + ["grabpla"] * 260 + ["grabplay"] * 1500
    rng.shuffle(pool)
    docs = [(i, " ".join(pool[i::20]) + rng.choice(["", ".", "'s"])) for i in range(20)] + [(None, "zebras, Zebras"), (7, None), (7, ""), (8, "n" * 50 + " " + "n" * 49)] + [(9, "n" * 50 + " " + "n" * 49 + " " + "n" * 48)] * 6
    frame = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, word string")
    want = variants(docs)
    assert len(want) > 60 and any(w[0] for w in want.values()) and want["grapple"][:2] == ("grappla", "grabplay")
    assert grouped(spelling.group(frame)) == want
    assert spelling.group(frame.limit(0)).count() == 0


def test_variants_broadcast_nothing(spark, monkeypatch):
    """Spark sizes a neighbourhood by the words' files, so a join that may be broadcast sends it through the driver."""
    plans, kept = [], spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or kept(frame))
    docs = [(i, " ".join(["zebras", "zebra", "z" * 50, "z" * 49] * 5 + ["zebrass"] * 200)) for i in range(9)]
    found = spelling.group(spark.createDataFrame(docs, "doc_id long, text string"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert grouped(found)["zebras"][0] == "zebrass" and sum("Join" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)


def test_neighbourhood_is_whole_and_each_once():
    import numpy as np

    hashed = lambda w: int(spelling.reduced(np.array([w], dtype=np.uint64))[0])
    for word in ((1, 1, 2, 3, 3, 3), (2,), (3, 1, 3, 1)):
        keys, counts = spelling.neighbourhood(np.array([word], dtype=np.uint64), 3)
        text = "".join(map(str, word))
        want = {hashed([int(c) for c in v]) if v else 0 for v in edits_of(text, "123") | {text}}
        assert set(keys.tolist()) == want and len(keys) == len(want) == counts[0]


def test_variants_of_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert grouped(registry.op12_spelling_variants(spark, SF)) == variants(docs)


# op13
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(docs, items, width=10):
    windows = {}
    for i, text in items:
        words = low(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + width]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    found = []
    for i, text in docs:
        words = low(text)
        hit, named = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    named |= owners
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        found.append((i, len(words), len(hit), len(named), sha, bool(hit)))
    return Counter(found)


def told(frame):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in frame.collect())


@pytest.mark.parametrize("most", [7, 100_000])
def test_contamination_equals_brute_force(spark, most):
    rng = random.Random(13)
    text = lambda n, vocabulary: " ".join(rng.choices(vocabulary, k=n))
    few, many = ["a", "b", "1"], ["Tea", "é", "x9", "longerword", "日本", "b", "\x80q"]
    items = [(1, text(14, many)), (2, text(25, few)), (3, "a b"), (4, "é"), (5, "!?"), (None, text(11, many)), (6, None), (1, "never seen at all"), (10, text(9, many)), (11, "w" * 5000 + " b")]
    docs = [(i, text(rng.randint(0, 60), rng.choice([few, many]))) for i in range(40)]
    docs += [(50 + k, text(5, many) + "--" + (t or "").upper() + "\n" + text(5, few)) for k, (_, t) in enumerate(items)]
    docs += [(None, None), (None, ""), (7, items[0][1] + " " + items[0][1]), (7, items[0][1]), (7, items[0][1]), (8, text(3000, many) + items[1][1]), (9, "\x00 a\x00b\x7f"), (9, "W" * 5000 + "-b")]
    frame = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, runs string")
    known = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(docs, items)
    assert sum(n for w, n in want.items() if w[5]) > 10
    assert told(decontaminate.digests(decontaminate.search(frame, known, most=most))) == want
    assert told(decontaminate.digests(decontaminate.search(frame, known.limit(0), most=most))) == contamination(docs, [])
    assert decontaminate.search(frame.limit(0), known, most=most).count() == 0


def test_contamination_of_the_whole_table(spark):
    rows = lambda t, i: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, "text").collect()]
    want = contamination(rows("documents", "doc_id"), rows("benchmark", "item_id"))
    assert any(w[5] for w in want) and told(registry.op13_decontamination(spark, SF)) == want


def test_shifts_skip_most_positions():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9)))
    windows = [(b" " + " ".join(word() for _ in range(10)).encode() + b" ", "i") for _ in range(500)]
    (table,) = decontaminate.Matcher(windows).tables
    assert table.shift.mean() > 0.8 * table.most and table.most > 15


def test_conversations_meet_in_one_piece_or_many(spark):
    """A long conversation is cut over partitions and still answered as one."""
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"line {t}" + "." * (t % 7 > 0)) for t in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    parts = conversation.pieces(conversation.faults(conversation.damage(frame)), 100)
    assert parts.agg(F.max("rows")).first()[0] <= 100 and parts.count() >= 30
    import sys

    sys.setrecursionlimit(20_000)
    ((conv, got),) = [(r["conv_id"], tuple(r[c] for c in COLUMNS)) for r in conversation.repair(frame, most=100).collect()]
    assert got == plainly(harmed(rows)[conv])
