"""Spelling variants: one-edit neighbourhoods over a reduced alphabet.

Words are the distinct results of at least ``least`` code points and ``often``
occurrences. The letters are dealt to a few symbols, so that each symbol carries
about the same share of the words' letters, and a reduced word is the row of its
letters' symbols. The whole one-edit neighbourhood of each reduced word (itself,
each deletion, replacement and insertion of a symbol) is written as hashes and
joined with the reduced words: words one edit apart have reduced words at most
one edit apart, so no pair is lost, and a hash that two reduced words share only
adds a pair to verify. Pairs are verified on the words themselves.

Words of more than ``LONG`` code points travel as their digests, and the words
themselves are only fetched for the pairs found, so that a neighbourhood takes
eight bytes an edit and a digest whatever a word's length is.

Every join is merged: Spark would size a neighbourhood by the words' files and
send hundreds of times as much through the driver.

Defined results: a null text has no words; a null id is written as the empty
string; texts of any length are read whole; ties go to the smaller word in
code-point order; repeated rows count again; an empty table gives an empty result.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import column_texts, discard, materialize, sliced

SYMBOLS = 8
LONG = 48
AT_ONCE = 200_000  # distinct words that a task holds before it hands their counts on
LONG_TEXT = 1 << 22
DROP_ONE_IN = 199  # a run whose checksum this divides loses one code point
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def damaged(run: str, prefix: int) -> str:
    """The run, without one code point where the checksum of ``<id>:<run>`` says so; ``prefix`` is that of ``<id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DROP_ONE_IN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5) -> DataFrame:
    """(word, n) of the words of all texts, summed in tasks before they are shuffled."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("body"))
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches, "body"):
            for key, text in zip(column_texts(batch, "id"), column_texts(batch, "body")):
                low = text.encode().lower().decode()
                found = Counter(runs.findall(low)) if len(low) < LONG_TEXT else Counter(m.group() for m in runs.finditer(low))
                prefix = zlib.crc32(f"{key}:".encode())
                for run, n in found.items():
                    word = damaged(run, prefix)
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) > AT_ONCE:
                    yield emit(counts)
                    counts = Counter()
        yield emit(counts)

    return slim.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def dealt_letters(words: DataFrame, symbols: int = SYMBOLS) -> dict[str, int]:
    """A symbol, from 1, for each letter; the letters of the given words are at most the alphabet."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    load, found = [0] * symbols, {}
    for r in sorted(letters, key=lambda r: (-r["count"], r["letter"])):
        lightest = load.index(min(load))
        found[r["letter"]] = lightest + 1
        load[lightest] += r["count"]
    return found


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(_BASE))
    out[0] = 1
    return np.multiply.accumulate(out)


def reduced(rows: np.ndarray) -> np.ndarray:
    """Hashes of reduced words of one length (a row each, symbols from 1)."""
    return (rows * _powers(rows.shape[1])).sum(axis=1, dtype=np.uint64) if rows.shape[1] else np.zeros(len(rows), dtype=np.uint64)


def neighbourhood(rows: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all that is at most one edit from each row, each once, and how many each row has.

    Of the deletions in a run of one symbol only the last is taken, and no symbol
    is put in before its like, so that no result comes twice.
    """
    n, size = rows.shape
    power = _powers(size + 1)
    sums = np.zeros((n, size + 1), dtype=np.uint64)
    np.cumsum(rows * power[:size], axis=1, out=sums[:, 1:], dtype=np.uint64)
    whole = sums[:, -1:]
    parts, wanted = [whole], [np.ones((n, 1), dtype=bool)]
    parts.append(sums[:, :-1] + (whole - sums[:, 1:]) * _INVERSE)
    wanted.append(np.concatenate([rows[:, :-1] != rows[:, 1:], np.ones((n, 1), dtype=bool)], axis=1))
    after = np.concatenate([rows, np.zeros((n, 1), dtype=np.uint64)], axis=1)
    for c in np.arange(1, symbols + 1, dtype=np.uint64):
        parts.append(whole + (c - rows) * power[:size])
        wanted.append(rows != c)
        parts.append(sums + c * power + (whole - sums) * np.uint64(_BASE))
        wanted.append(after != c)
    keep = np.concatenate(wanted, axis=1)
    return np.concatenate(parts, axis=1)[keep], keep.sum(axis=1)


def _keyed(words: DataFrame, letters: dict[str, int], symbols: int, whole: bool) -> DataFrame:
    """``words`` with ``keys``: the hashes of the neighbourhood if ``whole``, else of the reduced word alone."""
    names = words.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = {ord(x): s for x, s in letters.items()}
        for batch in sliced(batches, "word", 1 << 16):
            lengths = pa.compute.utf8_length(batch.column(batch.schema.get_field_index("word"))).to_numpy()
            for size in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                text = "".join(column_texts(part, "word")).translate(symbol)
                rows = np.frombuffer(text.encode("ascii"), dtype=np.uint8).reshape(-1, size).astype(np.uint64)
                keys, counts = neighbourhood(rows, symbols) if whole else (reduced(rows), np.ones(len(rows), dtype=np.int64))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*names, "keys"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(each, f"{kept}, keys array<long>")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of words one edit apart."""
    letters = dealt_letters(words, symbols)
    sized = words.withColumn("size", F.length("word"))
    one_edit = F.levenshtein("word", "near", 1) == 1

    def joined(left: DataFrame, right: DataFrame, name) -> DataFrame:
        asked = _keyed(left, letters, symbols, True).select(name.alias("ref"), F.explode("keys").alias("key"))
        known = _keyed(right, letters, symbols, False).select(name.alias("near_ref"), F.col("n").alias("near_n"), F.col("keys")[0].alias("key"))
        return asked.join(known.hint("merge"), "key").filter("ref != near_ref").drop("key")

    short = joined(sized.filter(F.col("size") <= long), sized.filter(F.col("size") <= long + 1), F.col("word"))
    short = short.toDF("word", "near", "near_n").filter(one_edit)
    digest = F.unhex(F.sha2("word", 256))
    large = sized.filter(F.col("size") >= long)
    pairs = joined(sized.filter(F.col("size") > long), large, digest)
    spelt = large.select(digest.alias("ref"), "word")
    pairs = pairs.join(spelt.hint("merge"), "ref").join(spelt.toDF("near_ref", "near").hint("merge"), "near_ref")
    return short.unionByName(pairs.select("word", "near", "near_n").filter(one_edit))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows by pointer doubling; a form is in turn a word, or a root."""
    done, step = forms.select("word", F.col("form").alias("root")), None
    while True:
        step = done.select(F.col("word").alias("root"), F.col("root").alias("further"))
        next_ = materialize(done.join(step.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        done, moved = next_.drop("moved"), next_.filter("moved")
        if moved.isEmpty():
            return done


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, ratio: int = 5) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    The form is the near word of the largest count, if that is at least ``ratio``
    times the word's own; counts rise along forms, so following them ends.
    """
    words = materialize(counted(docs, id_col, text_col, least, often))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best")["less"] >= ratio * F.col("n")
    found = words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best")["near"]).alias("form"), F.when(strong, -F.col("best")["less"]).alias("form_n"),
    )
    found = materialize(found)
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
