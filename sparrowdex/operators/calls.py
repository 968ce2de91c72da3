"""Model calls on the executors: many at once, tried again by kind of error, within a time and a budget of tokens.

A request that gets no answer keeps its row and says why, so that callers go on without the model: hits keep their order,
a text stays as it was. Answers are written to the shared folder before anything reads them, so that a plan that is read
twice, or an executor that is lost later, asks nothing again; a task that is lost while it runs asks its own rows again.

Cases: a null request is not sent (`empty`). Rows with equal keys are requests of their own. An empty table gives an empty
one. Callers run in threads and have to allow that.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from . import vectors as V

#: Why a request has no answer, besides `answered`.
EMPTY, REFUSED, FAILED, LATE, OVER = "empty", "refused", "failed", "late", "over budget"
#: Hash ranges of three hexadecimal digits.
RANGES = 16**3


@dataclass(frozen=True)
class Limits:
    """at_once: calls at a time in a task; tasks: into how many the requests are dealt (0: as they are). tries, wait: a call
    that fails for now is made again after wait, 2 wait, 4 wait... seconds. seconds: for a request with all its tries, 0 for
    no limit. budget: tokens of all requests that are sent, 0 for no limit.
    """

    at_once: int = 8
    tasks: int = 0
    tries: int = 3
    wait: float = 0.5
    seconds: float = 60.0
    budget: int = 0


def passing(error: Exception) -> bool:
    """Whether an error may be gone at the next try: an OSError, but of statuses only 429 and 500 and up."""
    status = getattr(error, "status", None)
    return isinstance(error, OSError) and (status is None or status == 429 or status >= 500)


Reply = tuple[Any, str, str | None, int]  # answer, state, error, tries


def ask(request: Any, caller: Callable[[Any], Any], limits: Limits, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> Reply:
    """One request with its tries. A Retry-After (`after` of the error) goes before the doubled wait."""
    began, pause = now(), limits.wait
    for n in range(1, max(1, limits.tries) + 1):
        try:
            return caller(request), "answered", None, n
        except Exception as e:  # noqa: BLE001 - whatever a model's client raises costs its own request only
            said = f"{type(e).__name__}: {e}"
            if not passing(e):
                return None, REFUSED, said, n
            if n == max(1, limits.tries):
                return None, FAILED, said, n
            longer = max(getattr(e, "after", 0.0) or 0.0, 0.0) or pause
            if limits.seconds and now() - began + longer > limits.seconds:
                return None, LATE, said, n
            sleep(longer)
            pause *= 2
    raise AssertionError("unreachable")


def ask_all(requests: list[Any], caller: Callable[[Any], Any], limits: Limits) -> list[Reply]:
    """All requests, at_once at a time. One that takes over its seconds is given up, though its thread can't be stopped:
    where all threads hang the requests that are left are late without having been sent.
    """
    replies: list[Reply | None] = [None] * len(requests)
    started: dict[int, float] = {}
    ended: queue.SimpleQueue = queue.SimpleQueue()
    waiting, lock, closed = iter(range(len(requests))), threading.Lock(), threading.Event()

    def work() -> None:
        while not closed.is_set():
            with lock:
                i = next(waiting, None)
                if i is None:
                    return
                started[i] = time.monotonic()
            ended.put((i, ask(requests[i], caller, limits)))

    for _ in range(min(max(1, limits.at_once), len(requests))):
        threading.Thread(target=work, daemon=True).start()
    open_, hung = set(range(len(requests))), set()
    while open_:
        with lock:
            running = {i: t for i, t in started.items() if i in open_}
        left = min((t + limits.seconds - time.monotonic() for t in running.values()), default=0.05) if limits.seconds else 60.0
        try:
            i, reply = ended.get(timeout=max(0.001, left))
            hung.discard(i)
            if i in open_:
                replies[i] = reply
                open_.discard(i)
                started.pop(i, None)
        except queue.Empty:
            if not limits.seconds:
                continue
            for i, t in running.items():
                if time.monotonic() - t >= limits.seconds:
                    replies[i] = (None, LATE, f"no answer within {limits.seconds:g} s", 1)
                    open_.discard(i)
                    hung.add(i)
        if len(hung) >= max(1, limits.at_once):
            closed.set()
            for i in open_:
                replies[i] = (None, LATE, "all calls of the task hang", 0)
            break
    closed.set()
    return replies  # every place is filled


def _last_that_fits(hashed: DataFrame, budget: int) -> str:
    """The greatest hash up to which all tokens fit in the budget; an empty text where not even the first one does.

    Tokens are summed up by the next three digits of the hashes that lie around the budget's end, until one hash is left:
    sums of at most RANGES ranges come to the driver each time, and rows are summed up before they are shuffled.
    """
    prefix, before, last = "", 0, ""
    while True:
        own = hashed.filter(F.col("__h").startswith(prefix)) if prefix else hashed
        sums = own.groupBy(F.substring("__h", len(prefix) + 1, 3).alias("p")).agg(F.sum("prompt_tokens").alias("n"), F.min("__h").alias("low"), F.max("__h").alias("high"))
        for r in sums.orderBy("p").collect():  # at most RANGES rows
            if before + r.n > budget:
                if r.low == r.high:
                    return last
                prefix += r.p
                break
            before, last = before + r.n, r.high
        else:
            return last


def within_budget(requests: DataFrame, key: str, tokens: Column, budget: int) -> DataFrame:
    """requests with their tokens and sent: whether they and those before them, in the order of md5(key), fit in the budget.

    The order is that of a hash, so that what is left out is no matter of a source or of time. Requests with equal keys
    stand together: all are sent or none.
    """
    every = requests.withColumn("prompt_tokens", F.coalesce(tokens.cast("long"), F.lit(0)))
    if budget <= 0:
        return every.withColumn("sent", F.lit(True))
    hashed = every.withColumn("__h", F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return hashed.withColumn("sent", F.col("__h") <= _last_that_fits(hashed, budget)).drop("__h")


def call(requests: DataFrame, key: str, request: str, caller: Callable[[Any], Any], answer: str, limits: Limits | None = None, tokens: Column | None = None, reply_tokens: Callable[[Any], int] | None = None) -> DataFrame:
    """key, answer, state, error, tries, prompt_tokens, output_tokens of each row of requests.

    request: the column that caller is given; answer: the type (as in DDL) of what it gives back. tokens: of a request, a
    quarter of its bytes as text where not given. Only what was answered has output_tokens (reply_tokens, else 0), and what
    was not sent has tries 0.
    """
    limits = limits or Limits()
    size = tokens if tokens is not None else F.floor(F.octet_length(F.coalesce(F.to_json(F.struct(request)), F.lit(""))) / 4)
    ready = within_budget(requests.select(key, request), key, F.when(F.col(request).isNull(), 0).otherwise(size), limits.budget)
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = pdf[request].tolist()
            replies: list[Reply] = [(None, EMPTY, None, 0) if v is None else (None, OVER, None, 0) for v in values]
            go = [i for i, (v, sent) in enumerate(zip(values, pdf["sent"], strict=True)) if v is not None and sent]
            for i, reply in zip(go, ask_all([values[i] for i in go], caller, limits), strict=True):
                replies[i] = reply
            out = pd.DataFrame(replies, columns=["answer", "state", "error", "tries"], dtype=object)
            out.insert(0, key, pdf[key].to_numpy())  # text, as whole numbers beside nulls would lose digits
            out["prompt_tokens"] = [n if r[3] else 0 for n, r in zip(pdf["prompt_tokens"], replies, strict=True)]
            out["output_tokens"] = [reply_tokens(r[0]) if reply_tokens and r[1] == "answered" else 0 for r in replies]
            yield out

    if limits.tasks:
        ready = ready.repartition(limits.tasks)
    done = ready.withColumn(key, F.col(key).cast("string")).mapInPandas(run, f"`{key}` string, answer {answer}, state string, error string, tries int, prompt_tokens long, output_tokens long")
    return stored(done.withColumn(key, F.col(key).cast(kind)), "model-calls")


def ledger(calls: DataFrame, provider: str, model: str, call_site: str) -> DataFrame:
    """The rows of sent calls that vectors.usage_events prices."""
    names = {"provider": provider, "model": model, "call_site": call_site}
    total = (F.col("prompt_tokens") + F.col("output_tokens")).alias("total_tokens")
    return calls.filter("tries > 0").select(*(F.lit(v).alias(k) for k, v in names.items()), "prompt_tokens", total, "output_tokens")


def rerank(hits: DataFrame, questions: DataFrame, ranker: Callable[[str, list[str]], list[int]], limits: Limits | None = None, depth: int = 20, sure: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """hits (qid, path, place and others) in the ranker's order, and its calls.

    The ranker is given a question (qid, q) and the paths of its first `depth` hits, and gives places from 1. A question
    without an answer, or among sure (qid), keeps its order. Hits are grouped to at most `depth` paths a question.
    """
    first = hits.filter(F.col("place") <= depth)
    if sure is not None:
        first = first.join(sure.select("qid"), "qid", "left_anti")
    paths = first.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))
    asked = paths.join(questions.select("qid", "q"), "qid").select("qid", F.struct("q", "paths").alias("request"))
    calls = call(asked, "qid", "request", lambda r: [int(x) for x in ranker(r["q"], list(r["paths"]))], "array<int>", limits)
    ordered = V.apply_order(hits, calls.filter("state = 'answered'").select("qid", F.col("answer").alias("order")))
    return ordered.withColumn("place", F.col("new_place")).select(*hits.columns), calls
