"""Scores of a word model and of a causal attention model on subword ids.

Word counts come from every training text. Frequent words (at most ``TOP``, a
table of fixed size) are looked up in the tasks; counts of all others are joined
by word, so nothing that grows with the vocabulary is sent to a task whole.

A word is its subword ids: a head and the ids that continue it. With ``every_id``
the attention model reads all of them, one place each, and gives the next id in
two factors: its class (the most frequent ids alone, the others by rank) from the
ids before it, and the id within its class by counts; the probabilities of all
ids sum to one at each place. Without it, the model reads and gives the heads
alone in this way. The ids that continue one then follow from the counts of
whole words with that head, smoothed by a spelling of its ids one by one, so the
probabilities of all words, seen or not, sum to one. The attention model is
trained in numpy on every word of every training text, in windows laid end to
end, dealt by a hash to shards of like size: one shard sets out from small random
weights, all others from its result, and their parameters are averaged. A shard
is the same however the table is cut in files. Texts are scored whole in
overlapping windows, each word once, by batched masked attention.

Defined results: null texts count as empty, which hold the closing token alone;
repeated rows are scored alike; with no training text all counts are 0; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import _let_go, keep_for_stage, materialize, sliced

TOP = 1 << 16  # most frequent words, sent to the tasks
ALONE, BINS = 55, 8  # frequent heads with a class of their own; bins of rank
CLASSES = ALONE + 1 + BINS
CLOSE = ALONE  # class and code of the closing token, also what stands before a text
KNOWN = 2048  # frequent heads with an input vector of their own; others share their class's
NOTHING = 0xFFFF  # no code stands here
WIDTH, CONTEXT, SIZE = 32, 8, 16  # window, its least context, and vector size
SHARD = 1 << 21  # words of a shard, about
BATCH, LEAST_STEPS = 64, 60
ALPHA = 0.5  # weight of the spelling beside the counts of words


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


_SPACES = re.compile(r"[^\S ]")  # white space that a word may hold: there a match may cross words


class Speller:
    """Subword ids of words, each with the one space before it."""

    def __init__(self, path: str, pattern: str) -> None:
        self.encoding, ranks = _tokenizer(path, pattern)
        self.size = max(ranks.values()) + 1
        self.opens = np.zeros(self.size, dtype=bool)  # ids whose bytes begin with the space
        self.opens[[i for text, i in ranks.items() if text[:1] == b" "]] = True

    def ids(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode(errors="replace"))

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words laid end to end, and where each word's begin."""
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        text = (b" " + b" ".join(words)).decode(errors="replace")
        if not _SPACES.search(text):  # no match of the pattern crosses a space before a word
            ids = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(words):
                return ids, starts
        each = [self.ids(w) for w in words]
        return np.concatenate([np.array(x, dtype=np.int64) for x in each]), np.cumsum([0] + [len(x) for x in each])[:-1]


@lru_cache(maxsize=2)
def _speller(path: str, pattern: str) -> Speller:
    return Speller(path, pattern)


@dataclass(frozen=True)
class Subwords:
    """What the counts tell of each subword id: all arrays have the vocabulary's size."""

    path: str
    pattern: str
    code: np.ndarray  # what the attention model reads for a head
    emission: np.ndarray  # log10 probability of a head within its class, less that of its words' weight
    spelt: np.ndarray  # log10 probability of an id that continues a word
    stop: float  # log10 probability that a word goes no further
    every_id: bool = False  # whether the attention model reads and gives every id: codes and emissions are then of all ids

    def words(self, frequent: dict[bytes, int]) -> "_Words":
        return _Words(_speller(self.path, self.pattern), self, frequent)


class _Words:
    """Arrays by a word's number: ``code``, ``base`` (log10 weight of its count), ``beside`` (log10 of its score beside
    the class), ``seen`` and ``spelt`` (its log10 probability by ids).

    Frequent words come first and stay; the others, ``names``, lack what their
    count tells and are those of the last slice of texts. ``pool`` holds the codes
    of all ids of a word, from ``begin`` on; with every id read, ``beside`` is the
    sum of their emissions.
    """

    NAMES = ("code", "base", "beside", "seen", "spelt", "pool", "begin", "size")

    def __init__(self, speller: Speller, model: Subwords, frequent: dict[bytes, int]) -> None:
        self.speller, self.model = speller, model
        top = [w for w in frequent if w]
        self.top = pa.array(top, pa.binary())
        code, own, spelt, pool, size = self._spell(top)
        c = np.array([frequent[w] for w in top], dtype=np.float64)
        with np.errstate(divide="ignore"):
            beside = own if model.every_id else own + np.where(c > 0, np.log10(c + ALPHA * 10**spelt), spelt + np.log10(ALPHA))
        self.of_top = code, np.log10(c + 0.5), beside, c > 0, spelt, pool, np.cumsum(size) - size, size

    def _spell(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Code, log10 of the emission, and log10 probability of the ids that follow the head, of each word; the codes of all ids and how many each has."""
        ids, starts = self.speller.many(words)
        heads = ids[starts]
        later = self.model.spelt[ids]
        later[starts] = 0.0
        total = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        codes = self.model.code[ids].astype("<u2")
        emission = total(self.model.emission[ids]) if self.model.every_id else self.model.emission[heads]
        return codes[starts], emission, total(later) + self.model.stop, codes, np.diff(np.append(starts, len(ids)))

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of distinct words, which the arrays then hold."""
        found = pc.index_in(distinct, value_set=self.top)
        other = found.is_null()
        self.names = distinct.filter(other)
        fresh = bytes_of(self.names)
        code, own, spelt, pool, size = self._spell(fresh)
        nothing = np.zeros(len(fresh))
        more = code, nothing, own, nothing > 0, spelt, pool, np.cumsum(size) - size + len(self.of_top[5]), size
        for name, known, new in zip(self.NAMES, self.of_top, more):
            setattr(self, name, np.concatenate([known, new]))
        number = found.fill_null(0).to_numpy().astype(np.int64)
        number[other.to_numpy(zero_copy_only=False)] = len(self.top) + np.arange(len(fresh))
        return number

    def lines(self, at: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The codes of each text, of all ids or of heads alone, for the words ``at`` of all texts laid end to end."""
        if not self.model.every_id:
            return coded_lines(self.code[at], lengths)
        size = self.size[at]
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - (ends - size), size)
        until = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        return coded_lines(self.pool[places], np.diff(until))


def bytes_of(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


_READY: dict[int, _Words] = {}  # kept for a stage


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, which of them each word is, all texts laid end to end, and how many words each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = cut.flatten().dictionary_encode()
    distinct, at = found.dictionary.cast(pa.binary()), found.indices.to_numpy().astype(np.int64)
    lengths = pc.list_value_length(cut).to_numpy().astype(np.int64)
    empty = pc.index(distinct, pa.scalar(b"", pa.binary())).as_py()
    if empty >= 0:  # what stands before a first space and behind a last one
        there = at != empty
        lengths = np.diff(np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(lengths)])])
        at = at[there]
        at -= at > empty
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
    return distinct, at, lengths


def coded_lines(codes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The codes of each text between two closing codes."""
    ends = np.cumsum(lengths + 2)
    data = np.full(ends[-1] if len(ends) else 0, CLOSE, dtype="<u2")
    data[np.arange(len(codes)) + 1 + 2 * np.repeat(np.arange(len(lengths)), lengths)] = codes
    return [data[e - n - 2 : e] for e, n in zip(ends.tolist(), lengths.tolist())]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a column ``body``; the empty word stands for the closing token."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body", 16 << 20):
            distinct, at, _ = split_words(batch.column(batch.schema.get_field_index("body")))
            words = pa.concat_arrays([distinct, pa.array([b""], pa.binary())])
            times = np.append(np.bincount(at, minlength=len(distinct)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([words, pa.array(times, pa.int64())], names=["word", "c"])

    return texts.mapInArrow(each, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """How often each subword id is a word's head, and continues a word: two numbers for each id of the vocabulary."""
    size = _speller(path, pattern).size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = _speller(path, pattern)
        total = np.zeros(2 * size, dtype=np.int64)
        for batch in batches:
            words, times = bytes_of(batch.column(0)), batch.column(1).to_numpy()
            there = np.array([bool(w) for w in words], dtype=bool)
            ids, starts = speller.many([w for w in words if w])
            ends = np.append(starts[1:], len(ids))
            shift = np.full(len(ids), size)
            shift[starts] = 0
            np.add.at(total, ids + shift, np.repeat(times[there], ends - starts))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "c"])

    rows = counts.mapInArrow(each, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(2 * size, dtype=np.int64)
    out[rows.column("id").to_numpy()] = rows.column("c").to_numpy()
    return out[:size], out[size:]


def classes_of_codes(n: int = CLASSES + KNOWN) -> np.ndarray:
    """The class of each code: codes below CLASSES are classes, the others heads by rank."""
    rank = np.arange(n - CLASSES)
    far = np.minimum(np.log2(np.maximum(rank, ALONE) / ALONE).astype(np.int64), BINS - 1)
    return np.concatenate([np.arange(CLASSES), np.where(rank < ALONE, rank, ALONE + 1 + far)])


def subwords(heads: np.ndarray, later: np.ndarray, path: str, pattern: str, every_id: bool = False) -> Subwords:
    n, words = later.sum(), heads.sum()
    spelt = np.log10((later + 0.5) / (n + 0.5 * len(later))) + np.log10((n + 0.5) / (n + words + 1))
    if every_id:
        heads = heads + later
    order = np.lexsort((np.arange(len(heads)), -heads))
    rank = np.empty(len(heads), dtype=np.int64)
    rank[order] = np.arange(len(heads))
    of = classes_of_codes(CLASSES + len(heads))[CLASSES + rank]
    code = np.where(rank < KNOWN, CLASSES + rank, of)
    mass = np.bincount(of, weights=heads + 0.5, minlength=CLASSES)
    emission = np.log10((heads + 0.5) / mass[of]) - (0.0 if every_id else np.log10(heads + ALPHA))
    return Subwords(path, pattern, code, emission, spelt, float(np.log10((words + 0.5) / (n + words + 1))), every_id)


def start_parameters(heads: np.ndarray, closings: int) -> list[np.ndarray]:
    """Small random weights, and the classes' frequencies as offsets."""
    rng = np.random.default_rng(0)
    by_rank = np.sort(heads)[::-1]
    mass = np.bincount(classes_of_codes(CLASSES + len(heads))[CLASSES:], weights=by_rank, minlength=CLASSES) + 1.0
    mass[CLOSE] += closings
    shapes = [(CLASSES + KNOWN, SIZE), (WIDTH, SIZE), *[(SIZE, SIZE)] * 4, (SIZE, CLASSES)]
    weights = [rng.normal(0, 0.3 if i in (0, 6) else 0.1 if i == 1 else SIZE**-0.5, s).astype(np.float32) for i, s in enumerate(shapes)]
    return [*weights, np.log(mass / mass.sum()).astype(np.float32)]


_MASK = np.triu(np.full((WIDTH, WIDTH), -1e9, dtype=np.float32), 1)
_SEEN = np.tril(np.ones((WIDTH, WIDTH), dtype=np.float32))


def _plain(total: np.ndarray) -> bool:
    """Whether exponentials that have these sums were neither too large nor all too small to tell."""
    return total.min() > 1e-20 and total.max() < 1e30


def joint(w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Products of the weights: what turns a place into its query times the keys' weights beside its value times the
    output's, and the classes' weights with their offsets as last column."""
    e, p, wq, wk, wv, wo, u, b = w
    return np.concatenate([wq @ wk.T * wq.dtype.type(SIZE**-0.5), wv @ wo], axis=1), np.concatenate([u.T, b[:, None]], axis=1)


def attended(h: np.ndarray, turned: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the places from ``first`` on: weights of the places seen, one over their sum, and the weighted mean of values."""
    query, key, one = turned[:, first:, :SIZE], h.transpose(0, 2, 1), np.ones(WIDTH, dtype=h.dtype)
    a = query @ key
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        a *= _SEEN[first:]
        total = a.reshape(-1, WIDTH) @ one
    if not _plain(total):
        a = query @ key + _MASK[first:]
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        total = a.reshape(-1, WIDTH) @ one
    share = 1 / total
    mean = (a @ turned[:, :, SIZE:]).reshape(-1, SIZE)
    mean *= share[:, None]
    return a, share, mean


def powers(classes: np.ndarray, out: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of what the classes give for each place, a column a place, and their sums; what the class ``told`` of
    each place gave. Where exponentials would be too far from 1, a column's largest is taken from it before."""
    one, at = np.ones(len(classes), dtype=classes.dtype), (told, np.arange(len(out)))
    z = classes @ out.T
    hit = z[at]
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(z, out=z)
        total = one @ z
    if not _plain(total):
        z = classes @ out.T
        z -= z.max(axis=0)
        hit = z[at]
        np.exp(z, out=z)
        total = one @ z
    return z, total, hit


def placed(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    h = w[0].take(x, axis=0)
    h += w[1]
    return h


def beside_one(rows: np.ndarray) -> np.ndarray:
    """The rows with a last column of ones, which offsets are multiplied with."""
    out = np.empty((len(rows), SIZE + 1), dtype=rows.dtype)
    out[:, :SIZE], out[:, SIZE] = rows, 1
    return out


def forward(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log-probabilities (natural) of the class after each place of each window."""
    turn, classes = joint(w)
    h = placed(w, x)
    out = h.reshape(-1, SIZE) + attended(h, (h.reshape(-1, SIZE) @ turn).reshape(*x.shape, -1))[2]
    z = (classes @ beside_one(out).T).T
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z, (h, out)


def gradients(w: list[np.ndarray], x: np.ndarray, y: np.ndarray, used: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log-probability of classes ``y`` at the places ``used``."""
    e, p, wq, wk, wv, wo, u, b = w
    turn, classes = joint(w)
    h = placed(w, x)
    flat, shape = h.reshape(-1, SIZE), h.shape
    turned = (flat @ turn).reshape(*x.shape, -1)
    a, share, mean = attended(h, turned)
    out = beside_one(flat + mean)
    d, total, _ = powers(classes, out, y.ravel())
    weight = (used.ravel() / max(1, used.sum())).astype(d.dtype)
    d *= weight / total
    d[y.ravel(), np.arange(d.shape[1])] -= weight
    dclasses, dout = d @ out, d.T @ classes[:, :SIZE]
    # The weights ``a`` stay without their sum; what comes back is divided instead.
    dmean = dout * share[:, None]
    ds = dmean.reshape(shape) @ turned[:, :, SIZE:].transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", dmean, mean).reshape(*x.shape, 1)
    ds *= a
    dturned = np.empty_like(turned)
    dturned[:, :, :SIZE] = ds @ h
    dturned[:, :, SIZE:] = a.transpose(0, 2, 1) @ dmean.reshape(shape)
    dturned = dturned.reshape(len(flat), -1)
    dh = dturned @ turn.T
    dh += dout
    dh += (ds.transpose(0, 2, 1) @ turned[:, :, :SIZE]).reshape(-1, SIZE)
    dturn = flat.T @ dturned
    dqk, dvo = dturn[:, :SIZE] * e.dtype.type(SIZE**-0.5), dturn[:, SIZE:]
    order = np.argsort(x.ravel(), kind="stable")
    rows = x.ravel()[order]
    starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
    de = np.zeros_like(e)
    de[rows[starts]] = np.add.reduceat(dh.take(order, axis=0), starts, axis=0)
    return [de, dh.reshape(shape).sum(axis=0), dqk @ wk, dqk.T @ wq, dvo @ wo.T, wv.T @ dvo, dclasses[:, :SIZE].T, dclasses[:, SIZE]]


def train(w: list[np.ndarray], windows: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adam over windows of WIDTH + 1 codes (NOTHING: none there), in random order; the rate falls to a tenth."""
    shapes, of = [m.shape for m in w], classes_of_codes()
    flat = np.concatenate([m.ravel() for m in w])
    first, second, now, root = (np.zeros_like(flat) for _ in range(4))
    cut = lambda x: [m.reshape(s) for m, s in zip(np.split(x, np.cumsum([np.prod(s) for s in shapes])[:-1]), shapes)]
    w, into = cut(flat), cut(now)  # views
    rng, step, steps = np.random.default_rng(seed), 0, max(LEAST_STEPS, -(-len(windows) // BATCH)) if len(windows) else 0
    while step < steps:
        order = rng.permutation(len(windows))
        for s in range(0, len(order), BATCH):
            rows = windows[order[s : s + BATCH]]
            used = rows[:, 1:] != NOTHING
            x, y = np.where(rows[:, :-1] == NOTHING, CLOSE, rows[:, :-1]), of[np.where(used, rows[:, 1:], 0)]
            step += 1
            rate = 0.015 * max(0.1, 1 - step / steps) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
            for m, g in zip(into, gradients(w, x, y, used)):
                m[...] = g
            np.multiply(now, now, out=root)
            first *= 0.9
            now *= 0.1
            first += now
            second *= 0.99
            root *= 0.01
            second += root
            np.sqrt(second, out=root)
            root += 1e-8
            np.divide(first, root, out=root)
            root *= rate
            flat -= root
    return w


def cut_windows(line: np.ndarray) -> np.ndarray:
    """Windows of WIDTH + 1 codes (NOTHING: none there) laid end to end: every code after a line's first is told once."""
    number = -(-(len(line) - 1) // WIDTH)
    padded = np.full(number * WIDTH + 1, NOTHING, dtype="<u2")
    padded[: len(line)] = line
    return np.concatenate([padded[:-1].reshape(number, WIDTH), padded[WIDTH::WIDTH, None]], axis=1)


def coded(texts: DataFrame, known: dict[bytes, int], model: Subwords) -> DataFrame:
    """What scoring and training need of each text of (id, body, usable), read word by word once.

    ``row`` tells the row; ``line`` holds its codes; the sums leave out words that
    are not ``known``, which ``rare`` lists (spelt out where the ids are not read one by one).
    """
    id_type = texts.schema["id"].dataType.simpleString()
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((known, model))  # TOP words, a vocabulary

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        closings = known.get(b"", 0)
        _let_go()
        if id(model) not in _READY:  # one object for the tasks of a worker, which what is kept holds on to
            _READY.clear()
            _READY[id(model)] = model.words(known)
        keep_for_stage(_READY)
        own = _READY[id(model)]
        for batch in sliced(batches, "body", 2 << 20):
            distinct, at, lengths = split_words(batch.column(batch.schema.get_field_index("body")))
            at, n = own.numbers(distinct)[at], len(lengths)
            doc = np.repeat(np.arange(n), lengths)
            per_text = lambda x: np.bincount(doc, weights=x[at], minlength=n).astype(np.float64)  # noqa: E731 (whole numbers where no text has words)
            others = at >= len(own.top)
            pairs, times = np.unique(doc[others] * len(own.size) + at[others], return_counts=True)
            of, which = np.divmod(pairs, max(1, len(own.size)))
            kept = {"word": own.names.take(pa.array(which - len(own.top))), "times": pa.array(times, pa.int64())} | ({} if model.every_id else {"spelt": pa.array(own.spelt[which], pa.float64())})
            rare = pa.StructArray.from_arrays(list(kept.values()), names=list(kept))
            sums = [lengths + 1, (per_text(own.seen) + (closings > 0)).astype(np.int64), per_text(own.base) + float(np.log10(closings + 0.5)), per_text(own.beside)]
            lines = pa.array([x.tobytes() for x in own.lines(at, lengths)], pa.binary())
            starts = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
            columns = [*batch.columns[:3], lines, *map(pa.array, sums), pa.ListArray.from_arrays(starts, rare)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "usable", "line", "n_tokens", "n_known", "base", "score", "rare"])

    told_of = texts.select("id", F.xxhash64("id", "body").alias("row"), "usable", "body")
    each_rare = "word: binary, times: bigint" + ("" if model.every_id else ", spelt: double")
    kinds = f"usable boolean, line binary, n_tokens long, n_known long, base double, score double, rare array<struct<{each_rare}>>"
    return told_of.mapInArrow(each, f"id {id_type}, row long, {kinds}")


def training_lines(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, key, line) of every usable text of ``coded``."""
    return texts.filter("usable").select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.col("row").alias("key"), "line")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """All windows of the lines of each shard of a sorted partition."""
    now, held = None, []
    for batch in batches:
        for shard, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if held and shard != now:
                yield now, np.concatenate(held)
                held = []
            now = shard
            held.append(cut_windows(np.frombuffer(x, "<u2")))
    if held:
        yield now, np.concatenate(held)


def averaged(lines: DataFrame, w: list[np.ndarray]) -> list[np.ndarray]:
    """Parameters after each shard has trained on the windows of its lines, weighted by their number; ``w`` without any."""
    shapes, sizes = [m.shape for m in w], [m.size for m in w]
    shared = lines.sparkSession.sparkContext.broadcast(w)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for shard, found in _by_shard(batches):
            own = train(shared.value, found, shard)
            total = total + np.concatenate([m.ravel() for m in own]).astype(np.float64) * len(found)
            n += len(found)
        if n:
            parts = np.split(total, np.arange(4096, len(total), 4096))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts]), pa.array(np.full(len(parts), n))], names=["i", "s", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, s, n in zip(*[c.to_pylist() for c in batch.columns]):
                known = sums.setdefault(i, [0.0, 0])
                known[0] = known[0] + np.frombuffer(s)
                known[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([(s / n).tobytes() for s, n in sums.values()], pa.binary())], names=["i", "v"])

    sums = lines.repartition("shard").sortWithinPartitions("shard", "key", "line").mapInArrow(learn, "i long, s binary, n long")
    mean = sums.repartition("i").mapInArrow(add, "i long, v binary").toArrow().sort_by("i")  # one row for 4096 parameters
    if not mean.num_rows:
        return w
    flat = np.frombuffer(b"".join(mean.column("v").to_pylist())).astype(np.float32)
    return [m.reshape(s) for m, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]


def target_logs(w: list[np.ndarray], products: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, first: int) -> np.ndarray:
    """Log-probabilities (natural) of classes ``y`` after the places of windows ``x`` from ``first`` on; ``products``: of ``joint``."""
    turn, classes = products
    h = placed(w, x)
    late = attended(h, (h.reshape(-1, SIZE) @ turn).reshape(*x.shape, -1), first)[2]
    late += h[:, first:].reshape(-1, SIZE)
    _, total, hit = powers(classes, beside_one(late), y[:, first:].ravel())
    return (hit - np.log(total)).reshape(len(x), -1)


def score_sequences(w: list[np.ndarray], lines: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of the classes of each sequence of codes (its first stands before the text)."""
    lengths = np.array([len(x) for x in lines]) - 1  # codes to score
    data = np.concatenate([*lines, np.zeros(WIDTH + 1, dtype=np.uint16)])
    windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH + 1)
    begin, of = np.cumsum([0] + [len(x) for x in lines])[:-1], classes_of_codes()
    step = WIDTH - CONTEXT
    number = np.maximum(1, -(-(lengths - CONTEXT) // step))
    doc = np.repeat(np.arange(len(lines)), number)
    nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    out, places, products = np.zeros(len(lines)), np.arange(WIDTH), joint(w)
    # A text's first window scores all its places; later ones those after their context.
    for which, first in ((np.flatnonzero(nth == 0), 0), (np.flatnonzero(nth > 0), CONTEXT)):
        for s in range(0, len(which), BATCH):
            d, n = doc[which[s : s + BATCH]], nth[which[s : s + BATCH]]
            rows = windows[begin[d] + n * step]
            used = n[:, None] * step + places[first:] < lengths[d][:, None]
            got = target_logs(w, products, rows[:, :-1], of[rows[:, 1:]], first)
            out += np.bincount(d, weights=(got * used).sum(axis=1, dtype=np.float64), minlength=len(lines))
    return out


def score(docs: DataFrame, path: str, pattern: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", every_id: bool = False) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row; learns from rows that are ``usable``.

    With ``every_id`` the attention model reads and gives all ids of a word, else
    its head alone, and counts of words the rest.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"), usable.alias("usable"))
    counts = materialize(word_counts(slim.filter("usable").select("body")))
    told = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = told["n"], told["v"]
    top = counts.orderBy(F.desc("c"), "word").limit(TOP).toArrow()
    frequent = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist()))
    closings = counts.filter(F.octet_length("word") == 0).first()
    frequent[b""] = closings["c"] if closings else 0
    heads, later = subword_counts(counts, path, pattern)
    model = subwords(heads, later, path, pattern, every_id)
    told_ids = heads + later if every_id else heads
    weights = start_parameters(told_ids, frequent[b""])
    texts = materialize(coded(slim, frequent, model))
    lines = training_lines(texts, max(1, -(-(int(told_ids.sum()) + frequent[b""]) // SHARD)))
    weights = averaged(lines.filter("shard = 0"), weights)
    weights = averaged(lines.filter("shard > 0"), weights)
    shared = spark.sparkContext.broadcast(weights)  # a small model

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "line", 1 << 20):
            found = score_sequences(shared.value, [np.frombuffer(x, "<u2") for x in batch.column(6).to_pylist()]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(batch.column(5).to_numpy() + found)], names=["id", "row", "n_tokens", "n_known", "base", "score"])

    id_type = slim.schema["id"].dataType.simpleString()
    whole = texts.select("id", "row", "n_tokens", "n_known", "base", "score", "line")
    whole = whole.mapInArrow(each, f"id {id_type}, row long, n_tokens long, n_known long, base double, score double").withColumn("one", F.lit(1))
    c = F.coalesce("c", F.lit(0))
    rare = texts.select("id", "row", F.explode("rare").alias("r")).select("id", "row", "r.*").join(counts.hint("shuffle_hash"), "word", "left").select(
        "id",
        "row",
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(c > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.log10(c + 0.5)).alias("base"),
        F.lit(0.0).alias("score") if every_id else (F.col("times") * F.when(c > 0, F.log10(c + ALPHA * F.pow(F.lit(10.0), F.col("spelt")))).otherwise(F.col("spelt") + F.log10(F.lit(ALPHA)))).alias("score"),
        F.lit(0).alias("one"),
    )
    sums = whole.unionByName(rare).groupBy("id", "row").agg(F.sum("one").alias("m"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    # Repeated rows have been summed as one: each gets its share.
    apart = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("copy"))
    per = lambda x: F.col(x) / F.col("m")
    size = float(np.log10(total + 0.5 * (distinct + 1)))
    return apart.select(
        F.col("id").alias(id_col),
        per("n_tokens").cast("long").alias("n_tokens"),
        per("n_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (per("base") - per("n_tokens") * size).alias("base_score"),
        per("score").alias("score"),
    )
