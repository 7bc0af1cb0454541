"""Keyed streams in event-time order: the job state machine, deferral, heartbeats and the run log.

Rows wait in the state store until the watermark has passed them, then a key's rows are folded in order of time and sequence, whatever
batches, chunks or order they came in. A key has one timer: at its first waiting row or at its own next deadline. So a result also
comes where nothing arrives any more, and every split of the input into batches gives the same rows (rows behind the watermark aside).
A fold is a small class with the state that it carries on; a key's waiting rows are bounded by what the watermark's delay holds.
Keys share the entries of the state store by a hash: a call to the store takes milliseconds, and each entry needs several.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Which event moves a job from which states to which.
TRANSITIONS = {
    "claim": (("pending",), "in_progress"), "complete": (("in_progress",), "completed"), "fail": (("in_progress",), "failed"), "pause": (("pending", "in_progress"), "paused"),
    "resume": (("paused",), "pending"), "retry": (("failed", "cancelled"), "pending"), "cancel": (("pending", "in_progress", "paused"), "cancelled"),
}
SECOND = 1_000_000
#: Entries of the state store that all keys share.
ENTRIES = 1024
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a run, then as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Fold:
    """What one key's rows (at, seq, kind, number) do in order. Times are microseconds."""

    #: Columns of the rows that it gives, after the key.
    output: str

    def start(self) -> dict:
        raise NotImplementedError

    def row(self, state: dict, at: int, seq: int, kind: str, number: int | None) -> list[tuple]:
        raise NotImplementedError

    def deadline(self, state: dict) -> int | None:
        """When something happens without a row."""
        return None

    def due(self, state: dict) -> list[tuple]:
        """What happens at the deadline; a row of the same time comes first."""
        return []

    def view(self, state: dict) -> list[tuple]:
        """What the state says now; given for each batch by provisional streams."""
        return []


class _InOrder(StatefulProcessor):
    """An entry's states and waiting rows (id, at, seq, kind, number) of all its ids; an id is text, empty for null."""

    def __init__(self, fold: Fold, names: Sequence[str], provisional: bool):
        self.fold, self.names, self.provisional = fold, list(names), provisional

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "states string, waiting string")

    def _folded(self, state: dict, rows: list[tuple], until: int | None) -> list[tuple]:
        """Fold rows in order, with the deadlines between them and, up to until, after them."""
        out = []
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            while (due := self.fold.deadline(state)) is not None and due < r[0]:
                out += self.fold.due(state)
            out += self.fold.row(state, *r)
        while until is not None and (due := self.fold.deadline(state)) is not None and due <= until:
            out += self.fold.due(state)
        return out

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """Rows (id, ...) as a frame whose numbers stay whole beside nulls."""
        if rows:
            yield pd.DataFrame([(int(r[0]) if r[0] else None, *r[1:]) for r in rows], columns=self.names, dtype=object)

    def _load(self) -> tuple[dict[str, dict], list[tuple]]:
        states, waiting = map(json.loads, self.held.get()) if self.held.exists() else ({}, [])
        return states, list(map(tuple, waiting))

    def _save(self, states: dict[str, dict], waiting: list[tuple]) -> None:
        """States and waiting rows as JSON, and the timer that they ask for: a list of the store costs more for each row than the fold does."""
        self.held.update((json.dumps(states), json.dumps(waiting)))
        self._wake(states, waiting)

    def _wake(self, states: dict[str, dict], rows: list[tuple]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        times = [r[1] for r in rows] + [x for x in map(self.fold.deadline, states.values()) if x is not None]
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))

    @staticmethod
    def _by_id(rows: list[tuple]) -> dict[str, list[tuple]]:
        out: dict[str, list[tuple]] = {}
        for r in rows:
            out.setdefault(r[0], []).append(r[1:])
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (states, waiting), came = self._load(), set()
        for pdf in rows:
            number = [None if n is None or n != n else int(n) for n in pdf["number"].tolist()]
            ids = pdf["id"].tolist()
            came.update(ids)
            waiting += zip(ids, pdf["at"].tolist(), pdf["seq"].tolist(), pdf["kind"].tolist(), number, strict=True)
        self._save(states, waiting)
        if self.provisional:
            out = []
            for i, own in self._by_id([r for r in waiting if r[0] in came]).items():
                copy = json.loads(json.dumps(states[i])) if i in states else self.fold.start()
                self._folded(copy, own, None)
                out += [(i, *r) for r in self.fold.view(copy)]
            yield from self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        states, waiting = self._load()
        ready, out = self._by_id([r for r in waiting if r[1] <= until]), []
        for i in ready.keys() | states.keys():
            state = states.setdefault(i, self.fold.start())
            out += [(i, *r) for r in self._folded(state, ready.get(i, []), until)]
        left = [r for r in waiting if r[1] > until]
        self._save(states, left)
        yield from () if self.provisional else self._frame(out)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, fold: Fold, late: str, provisional: bool = False, entries: int = ENTRIES) -> DataFrame:
    """Fold a stream of events (id, ts, seq, kind, number) by id in order of ts and seq.

    Rows come when the watermark, late behind the latest event, has passed their time. A provisional stream instead gives, for each batch, what
    the states of its ids are with all that has come, in order, and keeps the states that the watermark has settled. An entry's ids and waiting
    rows are in a task's memory together: entries should grow with them.
    """
    text = F.coalesce(F.col("id").cast("long").cast("string"), F.lit(""))
    rows = events.select(F.pmod(F.xxhash64(text), F.lit(entries)).alias("entry"), text.alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "kind", F.col("number").cast("long").alias("number"))
    names = ["id", *(c.split()[0] for c in fold.output.split(", "))]
    return rows.withWatermark("ts", late).groupBy("entry").transformWithStateInPandas(_InOrder(fold, names, provisional), f"id long, {fold.output}", "update" if provisional else "append", "EventTime")


class Machine(Fold):
    """Job states by TRANSITIONS; an action that a state doesn't know is refused."""

    output = "status string, applied long, refused long"

    def start(self) -> dict:
        return {"status": "pending", "applied": 0, "refused": 0}

    def row(self, state, at, seq, kind, number):
        sources, target = TRANSITIONS.get(kind, ((), ""))
        if state["status"] in sources:
            state["status"] = target
            state["applied"] += 1
        else:
            state["refused"] += 1
        return []

    def view(self, state):
        return [(state["status"], state["applied"], state["refused"])]


class Deferral(Fold):
    """A busy backend puts a job off by the next step of a schedule (or by the number of seconds that it names); progress ends the spell.

    deferred says until when, woken that the time has come without another event, paused that the spell has lasted as long as the ceiling; a
    paused job waits for progress and nothing else.
    """

    output = "at long, outcome string, n long, until long"

    def __init__(self, schedule: Sequence[int] = (300, 900, 3600), ceiling: int = 86_400):
        self.schedule, self.ceiling = list(schedule), ceiling

    def start(self) -> dict:
        return {"n": 0, "first": None, "until": None, "paused": False}

    def row(self, state, at, seq, kind, number):
        if kind == "progress":
            state.update(self.start())
        elif kind == "busy" and not state["paused"]:
            state["until"] = None
            if state["first"] is not None and at - state["first"] >= self.ceiling * SECOND:
                state["paused"] = True
                return [(at, "paused", state["n"], None)]
            wait = self.schedule[min(state["n"], len(self.schedule) - 1)] if number is None else number
            state.update(n=state["n"] + 1, first=at if state["first"] is None else state["first"], until=at + wait * SECOND)
            return [(at, "deferred", state["n"], state["until"])]
        return []

    def deadline(self, state):
        return state["until"]

    def due(self, state):
        at, state["until"] = state["until"], None
        return [(at, "woken", state["n"], None)]


class Silence(Fold):
    """A row for each time that a key has been silent for so many seconds."""

    output = "last_beat long, stale_at long"

    def __init__(self, seconds: int):
        self.seconds = seconds

    def start(self) -> dict:
        return {"last": None}

    def row(self, state, at, seq, kind, number):
        state["last"] = at
        return []

    def deadline(self, state):
        return None if state["last"] is None else state["last"] + self.seconds * SECOND

    def due(self, state):
        last, state["last"] = state["last"], None
        return [(last, last + self.seconds * SECOND)]


class RunLog(Fold):
    """Runs of a source: running opens one (an open one is interrupted by that), another kind closes it as that; an end without a run is nothing."""

    output = "run long, status string, started long, finished long"

    def start(self) -> dict:
        return {"run": None, "at": None}

    def row(self, state, at, seq, kind, number):
        out = [] if state["run"] is None else [(state["run"], "interrupted" if kind == "running" else kind, state["at"], at)]
        state.update(run=seq, at=at) if kind == "running" else state.update(self.start())
        return out


class Throttle(Fold):
    """Requests of a key at one each interval of microseconds, after a burst of so many at once: when each may go.

    The state is one time, that of the next request in an even flow; a request may be ahead of it by the burst.
    """

    output = "seq long, at long, granted long"

    def __init__(self, interval: int, burst: int = 1):
        self.interval, self.ahead = interval, (burst - 1) * interval

    def start(self) -> dict:
        return {"next": 0}

    def row(self, state, at, seq, kind, number):
        granted = max(at, state["next"] - self.ahead)
        state["next"] = max(granted, state["next"]) + self.interval
        return [(seq, at, granted)]
