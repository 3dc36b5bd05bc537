"""Calls to models from tasks: ordered fail-over, breakers, deadlines and usage.

A provider is any callable; none is called here by name, and no network is used
but by what a user passes in. Each task keeps its own breakers, which may begin
with what a log of earlier calls says (``jobs.breaker_states``).
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAT_SECONDS = 90.0
THRESHOLD, COOLDOWN = 2, 300.0


class Refused(Exception):
    """A provider's refusal; 429 counts for its breaker, any refusal leads to the next provider."""

    def __init__(self, status: int, message: str = "") -> None:
        super().__init__(message or f"status {status}")
        self.status = status


@dataclass(frozen=True)
class Provider:
    """``call`` takes the request, and the key as ``key`` where one is needed; ``key`` is read in the task."""

    id: str
    model: str
    call: Callable
    priority: int = 0
    enabled: bool = True
    key: Callable[[], str | None] | None = None


@dataclass
class Breaker:
    refusals: int = 0
    until: float = -1.0


@dataclass
class Gateway:
    """Asks providers in order of priority until one answers; ``usage`` tells of every attempt."""

    providers: tuple[Provider, ...]
    seconds: float = CHAT_SECONDS
    clock: Callable[[], float] = time.monotonic
    open_for: dict[str, float] = field(default_factory=dict)  # seconds that a breaker is still open at the start
    usage: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        now = self.clock()
        self.breakers = {p.id: Breaker(THRESHOLD, now + self.open_for[p.id]) if self.open_for.get(p.id, 0) > 0 else Breaker() for p in self.providers}

    def ordered(self) -> list[Provider]:
        return sorted((p for p in self.providers if p.enabled), key=lambda p: (p.priority, p.id))

    def primary(self) -> str | None:
        """The model that is asked first."""
        return next((p.model for p in self.ordered()), None)

    def ask(self, *request) -> tuple[object, Provider, float]:
        """(answer, provider, milliseconds); what the last provider raised if none answers."""
        turns, outcome = self._turns(), None
        while True:
            try:
                p, more = turns.send(outcome)
            except StopIteration as done:
                return done.value
            try:
                outcome = timely(p.call, self.seconds, *request, **more), None
            except Exception as error:  # noqa: BLE001 - whatever a provider raises, the next one is asked
                outcome = None, error

    def answers(self, requests: list[tuple]) -> list:
        """What ``ask`` returns or raises for each request in turn.

        One thread makes all the calls and this one watches it, as handing each
        call over costs more than a quick answer. A late call keeps its thread,
        and another one goes on with what comes after it.
        """
        found: list = []
        turns, outcome = None, None
        while True:
            line = _Line(self, requests, found, turns, outcome)
            threading.Thread(target=line.run, daemon=True).start()
            if (turns := line.watched(self.seconds)) is None:
                break
            outcome = None, _late(self.seconds)
        if line.fatal is not None:
            raise line.fatal
        return found

    def _turns(self):
        """The calls of one request as (provider, further arguments), each told its (answer, error); returns what ``ask`` does."""
        if not self.ordered():
            raise LookupError("no provider is enabled")
        last: Exception = LookupError("every provider was skipped")
        for p in self.ordered():
            breaker = self.breakers[p.id]
            if breaker.until >= 0 and self.clock() < breaker.until:
                continue
            more = {}
            if p.key is not None:
                if not (key := p.key()):
                    last = LookupError(f"{p.id} has no key")
                    self._tell(p, 0.0, str(last))
                    continue
                more = {"key": key}
            began = self.clock()
            answer, error = yield p, more
            if error is not None:
                last = error
                if getattr(error, "status", None) == 429:
                    breaker.refusals += 1
                    if breaker.refusals >= THRESHOLD:
                        breaker.until = self.clock() + COOLDOWN
                self._tell(p, 1000 * (self.clock() - began), str(error) or type(error).__name__)
                continue
            breaker.refusals, breaker.until = 0, -1.0
            took = 1000 * (self.clock() - began)
            self._tell(p, took, None)
            return answer, p, took
        raise last

    def embed(self, texts: list[str]) -> list:
        """An embedder for ``operators.index``."""
        return self.ask(texts)[0]

    def _tell(self, p: Provider, ms: float, error: str | None) -> None:
        self.usage.append({"provider": p.id, "model": p.model, "latency_ms": ms, "success": error is None, "error": error})


_OWN = threading.local()  # one waiting thread for each calling one; a late call keeps its thread, and the next call gets another


def timely(call: Callable, seconds: float, *request, **more):
    """What ``call`` returns, unless it takes longer."""
    if getattr(_OWN, "pool", None) is None:
        _OWN.pool = ThreadPoolExecutor(1)
    try:
        return _OWN.pool.submit(call, *request, **more).result(seconds)
    except Late:
        _OWN.pool.shutdown(wait=False, cancel_futures=True)
        _OWN.pool = None
        raise _late(seconds) from None


def _late(seconds: float) -> TimeoutError:
    return TimeoutError(f"no answer in {seconds:g} seconds")


class _Line:
    """Requests that one thread answers one after another, from the one that ``found`` is still without."""

    def __init__(self, gateway: Gateway, requests: list[tuple], found: list, turns, outcome) -> None:
        self.gateway, self.requests, self.found, self.turns, self.outcome = gateway, requests, found, turns, outcome
        self.lock, self.over = threading.Lock(), threading.Event()
        self.began: float | None = None  # of the call under way
        self.left = False
        self.fatal: BaseException | None = None

    def run(self) -> None:
        try:
            self._run()
        except BaseException as error:  # noqa: BLE001 - the watching thread raises it
            self.fatal = error
        self.over.set()

    def _run(self) -> None:
        turns, outcome = self.turns, self.outcome
        while len(self.found) < len(self.requests):
            request = self.requests[len(self.found)]
            if turns is None:
                turns, outcome = self.gateway._turns(), None
            try:
                p, more = turns.send(outcome)
            except StopIteration as done:
                self.found.append(done.value)
                turns = None
                continue
            except Exception as error:  # noqa: BLE001 - one request without an answer must not end the others
                self.found.append(error)
                turns = None
                continue
            self.turns, self.began = turns, time.monotonic()
            try:
                outcome = p.call(*request, **more), None
            except Exception as error:  # noqa: BLE001 - whatever a provider raises, the next one is asked
                outcome = None, error
            with self.lock:
                if self.left:
                    return
                self.began = None

    def watched(self, seconds: float):
        """The turns whose call is late; None once all requests are answered."""
        wait = seconds
        while not self.over.wait(wait):
            with self.lock:
                wait = seconds if self.began is None else self.began + seconds - time.monotonic()
                if wait <= 0:
                    self.left = True
                    return self.turns
        return None


ANSWER = "raw string, provider string, model string, tokens long, latency_ms long, failure string"


def dealt(rows: DataFrame) -> DataFrame:
    """Rows spread evenly over as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def completed(prompts: DataFrame, gateway: Callable[[], Gateway], system: str = "", prompt: str = "prompt", deal: bool = True) -> DataFrame:
    """Rows with a chat answer each: raw, provider, model, tokens, latency_ms, and ``failure`` where no provider answered.

    ``gateway`` makes a task's gateway; its providers take (system, user) and return (text, tokens).
    Rows are dealt evenly first, unless they already are: an answer costs far more than sending a row.
    """
    if deal:
        prompts = dealt(prompts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gateway()
        for batch in batches:
            rows = []
            asked = [(system, text) for text in batch.column(batch.schema.get_field_index(prompt)).to_pylist()]
            found = own.answers(asked)
            own.usage.clear()  # else it grows with the task
            for answer in found:
                try:
                    if isinstance(answer, Exception):
                        raise answer
                    (raw, tokens), p, took = answer
                    rows.append((raw, p.id, p.model, int(tokens), int(took), None))
                except Exception as error:  # noqa: BLE001 - one source without an answer must not end the job
                    rows.append((None, None, None, 0, 0, str(error) or type(error).__name__))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "raw", "provider", "model", "tokens", "latency_ms", "failure"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(each, f"{kept}, {ANSWER}")


def reranker(call: Callable[[str, list[str]], list[tuple[int, float]]], query: Column, body: Column, seconds: float = 10.0) -> Callable[[DataFrame], DataFrame]:
    """An ``ask`` for ``ranking.reranked``: ``call`` maps a query and the head's texts to (index, score) answers.

    A call that raises, is late or answers nonsense gives no answers, so its query keeps its order.
    """

    def ask(head: DataFrame) -> DataFrame:
        key = head.schema["query_id"].dataType.simpleString()
        texts = head.withColumns({"__q": query, "__t": body}).groupBy("query_id").agg(
            F.first("__q").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("__t", F.lit("")).alias("t")))), lambda x: x["t"]).alias("texts")
        )  # at most a head of texts a query

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for k, q, t in zip(*(batch.column(n).to_pylist() for n in ("query_id", "q", "texts"))):
                    try:
                        rows += [(k, seq, float(i), float(s)) for seq, (i, s) in enumerate(timely(call, seconds, q, t))]
                    except Exception:  # noqa: BLE001 - ranking stands without the reranker
                        continue
                columns = list(zip(*rows)) if rows else [()] * 4
                made = [pa.array(columns[0], batch.schema.field("query_id").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())]
                yield pa.RecordBatch.from_arrays(made, names=["query_id", "seq", "index", "score"])

        return texts.mapInArrow(each, f"query_id {key}, seq int, index double, score double")

    return ask


def still_open(calls: DataFrame, now_ms: int, threshold: int = THRESHOLD, cooldown_ms: int = int(COOLDOWN * 1000)) -> dict[str, float]:
    """Seconds that each provider's breaker stays open after a log of calls (provider, id, at_ms, status), for ``open_for``.

    Providers are configured by name, so there are few; only theirs leave Spark.
    """
    order = Window.partitionBy("provider").orderBy(F.desc("at_ms"), F.desc("id"))
    since = F.sum((F.col("status") == 200).cast("int")).over(order)
    recent = calls.withColumn("__since", since).filter("__since = 0 and status = 429")
    found = recent.groupBy("provider").agg(F.count("*").alias("n"), F.max("at_ms").alias("last")).filter(F.col("n") >= threshold)
    left = found.select("provider", ((F.col("last") + cooldown_ms - now_ms) / 1000).alias("left")).filter("left > 0")
    return {r["provider"]: r["left"] for r in left.collect()}
