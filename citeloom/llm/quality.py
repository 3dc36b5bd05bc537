"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Which n-grams of words and of word shapes a text holds (hashed) are indicators;
each is scaled by its log-count ratio between the classes, and a linear hinge
model is fitted on them by dual coordinate descent. A shape keeps punctuation,
folds runs of letters and digits, and marks words that repeat a recent one.

The model is fitted on at most ``max_rows`` labelled rows, the first by a hash
of the id; every text is scored whole. Defined results: null texts count as
empty; empty texts hold no n-gram and get the score of the model's offset;
repeated rows get equal scores; ids without a label are scored alike; with no
labels, or one class only, every score is 0.5, or near that class. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import column_texts, keep_for_stage, sliced

BITS = 18
RECENT = 6  # a word that equals one of so many before it is marked
_RUN = re.compile(r"[^\W\d_]+|\d+")


def _shape(word: str) -> str:
    def fold(m: re.Match) -> str:
        s = m.group()
        return "0" if s[0].isdigit() else "a" if s.islower() else "A" if s.isupper() else "Aa"

    return _RUN.sub(fold, word)[:12]


class _Words(dict):
    """Hashes of a word (high half) and its shape (low half); starts again empty when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(_shape(word).encode())
        self[word] = found
        return found


_WORDS = _Words()


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out >> np.uint64(64 - BITS)


def features(text: str) -> np.ndarray:
    """Sorted distinct indicators of a text, each under 2**BITS."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    both = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    repeat = np.zeros(len(words), dtype=bool)
    for k in range(1, min(RECENT, len(words) - 1) + 1):
        repeat[k:] |= word[k:] == word[:-k]
    shape = shape << np.uint64(1) | repeat.astype(np.uint64)
    shape = shape ^ np.uint64(1 << 40)  # apart from the hashes of words
    found = [_mix(word), _mix(shape)]
    if len(words) > 1:
        found += [_mix(word[:-1], word[1:]), _mix(shape[:-1], shape[1:])]
    if len(words) > 2:
        found.append(_mix(shape[:-2], shape[1:-1], shape[2:]))
    return np.unique(np.concatenate(found)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # already scaled by the log-count ratios
    offset: float
    slope: float
    shift: float

    def score(self, text: str) -> float:
        f = features(text)
        margin = float(self.weights[f].sum(dtype=np.float64)) / max(1.0, len(f)) ** 0.5 + self.offset
        z = min(max(self.slope * margin + self.shift, -30.0), 30.0)
        return 1.0 / (1.0 + float(np.exp(-z)))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, alpha: float = 1.0) -> Model:
    """Fit on indicator rows with labels 0 and 1."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        shift = 0.0 if not len(y) else 4.0 * y[0]
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0, 0.0, shift)
    counts = {c: np.full(1 << BITS, alpha) for c in (1.0, -1.0)}
    for f, c in zip(rows, y):
        counts[c][f] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    values = [ratio[f] / max(1.0, len(f)) ** 0.5 for f in rows]  # long texts hold more n-grams
    scale = 1.0 / max(1e-9, float(np.mean([v @ v for v in values])) ** 0.5)
    share = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())  # classes weigh alike
    w, bias, dual = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    values = [v * scale for v in values]
    norms = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(y)).tolist():
            f, v, c = rows[i], values[i], cost * share[i]
            gradient = y[i] * (w[f] @ v + bias) - 1.0 + dual[i] / (2 * c)
            new = max(0.0, dual[i] - gradient / (norms[i] + 1 / (2 * c)))
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[f] += step * v
                bias += step
                dual[i] = new
    margins = np.array([w[f] @ v + bias for f, v in zip(rows, values)])
    # Platt's sigmoid of the margins, by Newton steps on smoothed targets.
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[h @ margins**2, h @ margins], [h @ margins, h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, [g @ margins, g.sum()])
        a, b = a - step[0], b - step[1]
    return Model((w * ratio * scale).astype(np.float32), bias, float(a), float(b))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Indicators and labels of at most ``max_rows`` labelled rows, the first by hash of the id."""
    chosen = labels.filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    joined = slim.join(F.broadcast(chosen), "id").select("id", "y", "body")  # at most max_rows small rows

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_for_stage(_WORDS)
        for batch in sliced(batches, "body"):
            rows = [features(t).tobytes() for t in column_texts(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(rows, pa.binary())], names=["id", "y", "f"])

    return joined.mapInArrow(each, "id string, y int, f binary")


def train(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    table = training_rows(docs, labels, label_col, usable, max_rows, id_col, text_col).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    rows = [np.frombuffer(x, dtype=np.int32) for x in table.column("f").to_pylist()]
    return fit(rows, np.array(table.column("y").to_pylist(), dtype=int))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, from 0 to 1; a column of that name is replaced."""
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the corpus

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        keep_for_stage(_WORDS)
        for batch in sliced(batches, text_col):
            scores = [m.score(t) for t in column_texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "quality_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(each, f"{schema}, quality_score double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
