"""Requests as keyed state with timers: results of superseded requests are dropped, requests expire, failures are retried later.

Time is the event time of a watermark, so what fires depends on the rows alone and a replayed stream gives the same. Rows of a
key in one batch are taken in order of their time. State of a key goes when its request expires or is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST_WAIT, LAST_WAIT = 5_000, 30_000


def wait_millis(attempt: int, first: int = FIRST_WAIT, last: int = LAST_WAIT) -> int:
    """How long to wait after a failure, from attempt 0: the first wait, doubled each time, up to the last."""
    return min(last, first << min(attempt, 20))


def with_timers(spark: SparkSession) -> None:
    """Sets the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _by_time(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("time", kind="stable")


class _Current(StatefulProcessor):
    """The newest generation of an owner, and when it expires."""

    def __init__(self, owner: str, expiry: int):
        self.owner, self.expiry = owner, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "generation long, until long")

    def _drop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        generation, until = self.now.get() if self.now.exists() else (-1, -1)
        began = generation, until
        for r in _by_time(rows).itertuples(index=False):
            time = int(r.time.value // 1_000_000)
            if 0 <= until <= time:  # over before this row, though the watermark hasn't said so yet
                out.append((*key, generation, None, "expired"))
                until = -1
            if r.payload is None or pd.isna(r.payload):  # a request
                if r.generation > generation:
                    generation, until = int(r.generation), time + self.expiry
            elif r.generation == generation and until >= 0:
                out.append((*key, generation, r.payload, "result"))
        if (generation, until) != began:
            self._drop_timers()
            self.now.update((generation, until))
            if until >= 0:
                self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=[self.owner, "generation", "payload", "kind"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        generation, _ = self.now.get()
        self.now.update((generation, -1))  # an older request doesn't come back
        yield pd.DataFrame([(*key, generation, None, "expired")], columns=[self.owner, "generation", "payload", "kind"])

    def close(self) -> None:
        pass


def current_results(events: DataFrame, owner: str, expiry_ms: int, late: str = "0 seconds") -> DataFrame:
    """(owner, generation, payload, kind) of events (owner, generation, payload, time: a timestamp): an event without payload is a request, one with it the result of a generation. Results of the newest request come through until it expires; those of superseded ones are dropped, and so is what a watermark is past. An expiry is a row of its own."""
    with_timers(events.sparkSession)
    kind = events.schema[owner].dataType.simpleString()
    keyed = events.withWatermark("time", late).select(owner, "generation", "payload", "time").groupBy(owner)
    return keyed.transformWithStateInPandas(_Current(owner, expiry_ms), f"{owner} {kind}, generation long, payload string, kind string", "Append", "EventTime")


class _Retries(StatefulProcessor):
    """How often an id's request has failed."""

    def __init__(self, key: str, first: int, last: int):
        self.key, self.first, self.last = key, first, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failed = handle.getValueState("failed", "attempts int, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, due = self.failed.get() if self.failed.exists() else (0, -1)
        out = []
        for r in _by_time(rows).itertuples(index=False):
            time = int(r.time.value // 1_000_000)
            if 0 <= due <= time:  # due before this row, though the watermark hasn't said so yet
                out.append((*key, attempts, due))
            attempts, due = (0, -1) if r.done else (attempts + 1, time + wait_millis(attempts, self.first, self.last))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if due < 0:
            self.failed.clear()
        else:
            self.failed.update((attempts, due))
            self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=[self.key, "attempt", "due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, due = self.failed.get()
        self.failed.update((attempts, -1))  # asked for; how often it has failed stays known
        yield pd.DataFrame([(*key, attempts, due)], columns=[self.key, "attempt", "due"])

    def close(self) -> None:
        pass


def retries(outcomes: DataFrame, key: str, first_ms: int = FIRST_WAIT, last_ms: int = LAST_WAIT, late: str = "0 seconds") -> DataFrame:
    """(key, attempt, due) of outcomes (key, done, time: a timestamp): after a failure a request is due again when its wait is over, longer after each; one that is done is forgotten, and fails from the beginning if it comes again."""
    with_timers(outcomes.sparkSession)
    kind = outcomes.schema[key].dataType.simpleString()
    keyed = outcomes.withWatermark("time", late).select(key, "done", "time").groupBy(key)
    return keyed.transformWithStateInPandas(_Retries(key, first_ms, last_ms), f"{key} {kind}, attempt int, due long", "Append", "EventTime")
