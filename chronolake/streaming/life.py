"""The life of tasks in state: retries with a cap, a watchdog, and the eviction of what has ended.

A shard is a group of tasks that are kept together.  Its events are taken in order (at, seq).  Maintenance runs at
every multiple of its interval, in event time: before an event all maintenance that is due is made up for, and a timer
does what is due when no event comes, so the result doesn't depend on batches.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolake.operators.results import TERMINAL
from chronolake.streaming.ordered import ROWS, in_order

EVENT = "shard long, at timestamp, seq long, task long, kind string, error string"
CHANGE = "shard long, task long, at timestamp, seq long, status string, reason string, retries int"
RETRYABLE = ("model_error", "engine_error")
ENDED = (*TERMINAL, "timed_out")


@dataclass(frozen=True)
class Limits:
    """Seconds that a task may run and is kept after its end; how many tasks are kept and retries made; the
    interval of maintenance; how many evicted ids are remembered."""

    running_s: int = 3600
    kept_s: int = 3600
    kept: int = 500
    retries: int = 2
    every_s: int = 60
    remembered: int = 10_000


class TaskLife(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getMapState("tasks", "task long", "status string, retries int, created long, started long, ended long")
        self.gone = handle.getValueState("gone", "ids binary")
        self.clock = handle.getValueState("clock", "done long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        out: list[tuple] = []
        for e in in_order(rows, ["at", "seq"]):
            now = e.at.value // 1000
            self._maintain(now, out)
            if e.task is not None and e.task == e.task and e.kind is not None:
                self._take(int(e.task), e.kind, e.error, now, int(e.seq), out)
            if len(out) >= ROWS:
                yield self._frame(key, out)
                out.clear()
        yield from self._done(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out: list[tuple] = []
        self._maintain(timerValues.getCurrentWatermarkInMs() * 1000, out)
        yield from self._done(key, out)

    def _load(self) -> None:
        self.tasks = {k[0]: list(v) for k, v in self.stored.iterator()}
        self.before = {k: tuple(v) for k, v in self.tasks.items()}
        self.done = self.clock.get()[0] if self.clock.exists() else None
        self.evicted: dict[int, None] | None = None
        # (time, task): when tasks that run were started, and when others ended. The first may hold some that run no longer.
        self.running = [(t[3] or t[2], task) for task, t in self.tasks.items() if t[0] == "processing"]
        self.over = [(t[4] or t[2], task) for task, t in self.tasks.items() if t[0] in ENDED]
        heapq.heapify(self.running)
        heapq.heapify(self.over)
        self.wake = self._due()

    def _gone(self) -> dict[int, None]:
        """Evicted tasks that are remembered, oldest first; one value of state, read once in a batch where it is asked for."""
        if self.evicted is None:
            self.evicted = dict.fromkeys(array("q", bytes(self.gone.get()[0])) if self.gone.exists() else ())
        return self.evicted

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["task", "at", "seq", "status", "reason", "retries"])
        frame["at"] = pd.to_datetime(frame["at"], unit="us")
        frame.insert(0, "shard", key[0])
        return frame.astype({"seq": "Int64", "retries": "Int32"})

    def _done(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for task in self.before.keys() - self.tasks.keys():
            self.stored.removeKey((task,))
        for task, t in self.tasks.items():
            if self.before.get(task) != tuple(t):
                self.stored.updateValue((task,), tuple(t))
        if self.evicted is not None:
            self.gone.update((array("q", self.evicted).tobytes(),))
        self.clock.update((self.done,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if self.wake is not None:
            self.handle.registerTimer(self.wake // 1000 + 1)
        if out:
            yield self._frame(key, out)

    def _take(self, task: int, kind: str, error: str | None, now: int, seq: int, out: list[tuple]) -> None:
        own = self.tasks.get(task)
        if kind == "status":
            status = own[0] if own else "expired" if task in self._gone() else "not_found"
            out.append((task, now, seq, status, "asked", own[1] if own else None))
            return
        if kind == "create":
            if own is None:
                self.tasks[task] = ["pending", 0, now, None, None]
                self._soon(now if len(self.tasks) > self.limits.kept else None)
                out.append((task, now, seq, "pending", "created", 0))
            return
        if own is None or own[0] in ENDED:
            return  # nothing changes what has ended
        reason = kind
        if kind == "start" and own[0] == "pending":
            own[0], own[3] = "processing", now
        elif kind == "done":
            own[0], own[4] = "completed", now
        elif kind == "cancel":
            own[0], own[4] = "cancelled", now
        elif kind == "error" and error in RETRYABLE and own[1] < self.limits.retries:
            own[0], own[1], reason = "pending", own[1] + 1, "retry"
        elif kind == "error":
            own[0], own[4], reason = "failed", now, error
        else:
            return
        if own[0] in ENDED:
            heapq.heappush(self.over, (own[4] or own[2], task))
            self._soon(now if len(self.tasks) > self.limits.kept else now + self.limits.kept_s * 1_000_000 + 1)
        elif own[0] == "processing":
            heapq.heappush(self.running, (own[3] or own[2], task))
            self._soon(now + self.limits.running_s * 1_000_000 + 1)
        out.append((task, now, seq, own[0], reason, own[1]))

    def _soon(self, at: int | None) -> None:
        """Maintenance may have something to do at ``at``; then it finds out what comes next."""
        if at is not None:
            tick = self._tick(at)
            self.wake = tick if self.wake is None else min(self.wake, tick)

    def _tick(self, at: int) -> int:
        every = self.limits.every_s * 1_000_000
        return -(-(at if self.done is None else max(at, self.done + 1)) // every) * every

    def _due(self) -> int | None:
        """When maintenance next has something to do: an interval's multiple after the last one."""
        at = []
        while self.running and not self._runs(*self.running[0]):
            heapq.heappop(self.running)
        if self.running:
            at.append(self.running[0][0] + self.limits.running_s * 1_000_000 + 1)
        if self.over:
            at.append(0 if len(self.tasks) > self.limits.kept else self.over[0][0] + self.limits.kept_s * 1_000_000 + 1)
        return self._tick(min(at)) if at else None

    def _runs(self, since: int, task: int) -> bool:
        own = self.tasks.get(task)
        return own is not None and own[0] == "processing" and (own[3] or own[2]) == since

    def _maintain(self, now: int, out: list[tuple]) -> None:
        """Makes up for all maintenance up to now; that which has nothing to do is passed over."""
        while self.wake is not None and self.wake <= now:
            self._at(self.wake, out)
            self.done = self.wake
            self.wake = self._due()
        every = self.limits.every_s * 1_000_000
        self.done = max(self.done or 0, now // every * every)

    def _at(self, now: int, out: list[tuple]) -> None:
        late = set()
        while self.running and now - self.running[0][0] > self.limits.running_s * 1_000_000:
            since, task = heapq.heappop(self.running)
            if self._runs(since, task):
                late.add(task)
        for task in sorted(late):
            own = self.tasks[task]
            own[0], own[4] = "timed_out", now
            heapq.heappush(self.over, (now, task))
            out.append((task, now, None, "timed_out", "watchdog", own[1]))
        while self.over and now - self.over[0][0] > self.limits.kept_s * 1_000_000:
            self._evict("kept too long", now, out)
        while self.over and len(self.tasks) > self.limits.kept:
            self._evict("too many", now, out)

    def _evict(self, reason: str, now: int, out: list[tuple]) -> None:
        """Of the tasks that have ended the oldest one goes; its id is remembered."""
        _, task = heapq.heappop(self.over)
        out.append((task, now, None, "evicted", reason, self.tasks.pop(task)[1]))
        gone = self._gone()
        gone.setdefault(task)
        if len(gone) > self.limits.remembered:
            del gone[next(iter(gone))]


def task_life(events: DataFrame, limits: Limits = Limits(), late: str = "10 seconds") -> DataFrame:
    """events: a stream of EVENT rows (create, start, done, error with its kind, cancel, status) in which at never goes
    back by more than ``late``. CHANGE rows: each change of a task, by an event (seq) or by maintenance (seq null), and
    answers to status: expired for evicted tasks that are remembered, not_found for unknown ones.

    Events of tasks that are unknown or have ended are ignored, as are those without a task or kind. The state of a
    shard is its live tasks, ``kept`` ended ones and what has ended since the last maintenance, and remembered ids.
    """
    marked = events.withWatermark("at", late).filter(F.col("shard").isNotNull() & F.col("at").isNotNull())
    return marked.groupBy("shard").transformWithStateInPandas(TaskLife(limits), CHANGE, "Append", "EventTime")
