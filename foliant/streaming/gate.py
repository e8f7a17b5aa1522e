"""A queue that lets a bounded number of jobs run at a time.

A message asks for a slot of its queue. With a slot free it starts and holds the slot for as long as its job takes; else it
comes back after a minute, ten times at most, and then goes to the dead letters. Messages, busy slots and
the next attempt are a queue's state, and timers wake it: by event time, so that the outcome is that of the messages'
own times whatever batches they come in, or by the clock, where a message counts from when it is seen.

An attempt is decided once no earlier one can come any more (its time is behind the watermark). Attempts at the same
time go by the message's own time, then by its id. A queue is one sequence by definition; queues are independent,
so a gate scales with their number. The state of a queue is what waits and runs, never what is done. What waits lies there in
sorted chunks and is read as its time comes, so a task holds a few chunks and what comes back, never a whole queue.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliant.functions import fixed

_TOLD = "queue string, message long, outcome string, retries int, micros long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A message that ends a stream: it moves the watermark and is no attempt.
END = "__end"
#: Attempts in a chunk of state, and those that are held while messages come in.
_CHUNK, _HELD = 4096, 1 << 18


@dataclass(frozen=True)
class Gate:
    slots: int = fixed.MAX_ACTIVE_JOBS
    retry_seconds: int = fixed.RETRY_SECONDS
    retries: int = fixed.MAX_RETRIES
    #: Attempts are ordered by event time; otherwise by the clock of the tasks.
    event_time: bool = True


def attempts(waiting: list[tuple], busy: list[int], gate: Gate, before: int) -> list[tuple]:
    """Decides, in order, all attempts before a time (microseconds); what is left stays in the two heaps.

    waiting: (at, asked, message, retries, microseconds of work); busy: when slots become free. Returns (message, outcome, retries, at).
    """
    told, again = [], gate.retry_seconds * 1_000_000
    while waiting and waiting[0][0] < before:
        at, asked, message, retries, work = heapq.heappop(waiting)
        while busy and busy[0] <= at:
            heapq.heappop(busy)
        if len(busy) < gate.slots:
            heapq.heappush(busy, at + work)
            told.append((message, "started", retries, at))
        elif retries < gate.retries:
            # no slot can become free before the first of the busy ones: attempts until then fail as this one does
            n = min(gate.retries - retries, -(-(busy[0] - at) // again)) if busy and again else 1
            heapq.heappush(waiting, (at + n * again, asked, message, retries + n, work))
        else:
            told.append((message, "dead", retries, at))
    return told


class _Queue(StatefulProcessor):
    def __init__(self, gate: Gate):
        self.gate = gate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk long", "packed binary")  # (at, asked, message, retries, work) of attempts in order
        self.begins = handle.getListState("begins", "at long, chunk long")
        self.busy = handle.getListState("busy", "until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        begins, fresh = self._begins(), []
        for part in rows:
            asked, n = part["asked"].to_numpy(np.int64), len(part)
            fresh.append(np.stack([asked if self.gate.event_time else np.full(n, now), asked, part["message"].to_numpy(np.int64), np.zeros(n, np.int64), part["work"].to_numpy(np.int64)], axis=1))
            if sum(map(len, fresh)) >= _HELD:
                self._put(np.concatenate(fresh), begins)
                fresh = []
        if fresh:
            self._put(np.concatenate(fresh), begins)
        yield from self._turn(key, begins, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, self._begins(), timerValues)

    def _begins(self) -> list[tuple]:
        return [tuple(x) for x in self.begins.get()] if self.begins.exists() else []

    def _put(self, rows: np.ndarray, begins: list[tuple]) -> None:
        """Attempts as new chunks; begins: the first time of each chunk and its number."""
        rows, free = rows[np.lexsort(rows.T[::-1])], max((c for _, c in begins), default=-1) + 1
        for i in range(0, len(rows), _CHUNK):
            self.chunks.updateValue((free,), (rows[i : i + _CHUNK].tobytes(),))
            begins.append((int(rows[i, 0]), free))
            free += 1

    def _turn(self, key: Any, begins: list[tuple], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        waiting, told = [], []
        busy = [x[0] for x in self.busy.get()] if self.busy.exists() else []
        heapq.heapify(begins), heapq.heapify(busy)
        until = (timerValues.getCurrentWatermarkInMs() if self.gate.event_time else timerValues.getCurrentProcessingTimeInMs() + 1) * 1000
        while True:
            while begins and begins[0][0] < until and (not waiting or begins[0][0] <= waiting[0][0]):
                _, chunk = heapq.heappop(begins)
                for row in np.frombuffer(self.chunks.getValue((chunk,))[0], np.int64).reshape(-1, 5).tolist():
                    heapq.heappush(waiting, tuple(row))
                self.chunks.removeKey((chunk,))
            if not waiting or waiting[0][0] >= until:
                break
            told += attempts(waiting, busy, self.gate, min(until, begins[0][0]) if begins else until)
            if len(told) >= _CHUNK:
                yield self._frame(key, told)
                told = []
        if waiting:
            self._put(np.array(waiting, np.int64), begins)
        self.begins.put(begins) if begins else self.begins.clear()
        self.busy.put([(x,) for x in busy]) if busy else self.busy.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if begins:
            self.handle.registerTimer(min(begins)[0] // 1000 + 1)  # the first instant at which the next attempt lies behind
        if told:
            yield self._frame(key, told)

    def _frame(self, key: Any, told: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *t) for t in told], columns=["queue", "message", "outcome", "retries", "micros"])

    def close(self) -> None:
        pass


def gated(messages: DataFrame, gate: Gate = Gate(), late: str = "1 hour") -> DataFrame:
    """queue, message, outcome, retries, at of a stream of messages: queue, message (id), at (timestamp), seconds (of work).

    By event time a message that comes later than `late` is lost to the watermark, as in any such stream; a row
    of queue END only moves the time on. Null queues, ids or times are no messages; null work takes no time.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # timers and lists need it
    d = messages.select("queue", "message", F.col("at").cast("timestamp").alias("at"), "seconds").where("queue is not null and message is not null and at is not null")
    if gate.event_time:
        d = d.withWatermark("at", late)
    # the condition names the time, or it would be tested before the watermark sees the row that ends the stream
    d = d.where(F.when(F.col("at").isNotNull(), F.col("queue") != END)).select("queue", "message", "at", F.unix_micros("at").alias("asked"), (F.coalesce(F.col("seconds"), F.lit(0)) * 1_000_000).cast("long").alias("work"))
    mode = "EventTime" if gate.event_time else "ProcessingTime"
    told = d.groupBy("queue").transformWithStateInPandas(_Queue(gate), _TOLD, "Append", mode)
    return told.select("queue", "message", "outcome", "retries", F.timestamp_micros("micros").alias("at"))
