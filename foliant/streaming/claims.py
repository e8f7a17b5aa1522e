"""Claims of a free sample by user and book, as a stream.

A user's state is who holds each book and the moves in the current window, packed, and read and written once a turn. The requests
that may still be overtaken by earlier ones are packed lists. Users are dealt into slots, which are the keys, so that very many users are no more keys: each
key costs calls to its state. A request is decided once the watermark has passed it, in the order of event time and id, so decisions
do not depend on batches; a timer wakes the slot for the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliant.functions import fixed
from foliant.streaming.gate import _ROCKS

_TOLD = "user long, request long, decision string"


class _Claims(StatefulProcessor):
    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "packed binary")  # (user, at, request, book, job, gone) of many requests
        self.users = handle.getMapState("users", "user long", "packed binary")  # window, moves, and (book, job, gone) of each book

    def decide(self, user: int, requests: list[list[int]]) -> list[str]:
        """Decisions on a user's requests, which come in order."""
        known = self.users.getValue((user,))
        packed = np.frombuffer(known[0], np.int64).tolist() if known else [0, 0]
        window, moves = packed[:2]
        holders, told = {b: (j, g) for b, j, g in zip(packed[2::3], packed[3::3], packed[4::3])}, []
        for at, _, book, job, gone in requests:
            held = holders.get(book)
            if held is None or held[0] == job:
                told.append("claimed" if held is None else "same")
            elif not held[1]:
                told.append("held")
                continue
            else:
                now = at // (self.window * 1_000_000)
                if now != window:
                    window, moves = now, 0
                if moves >= self.limit:
                    told.append("limited")
                    continue
                moves += 1
                told.append("moved")
            holders[book] = (job, gone)
        self.users.updateValue((user,), (np.array([window, moves, *(x for b, h in holders.items() for x in (b, *h))], np.int64).tobytes(),))
        return told

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for part in rows:
            fresh = np.stack([part[c].to_numpy(np.int64) for c in ("user", "micros", "request", "book", "job", "gone")], axis=1)
            self.pending.appendList([(fresh.tobytes(),)])
            first = min(int(fresh[:, 1].min()), first if first is not None else int(fresh[0, 1]))
        if first is not None and first < now:
            yield from self._turn(now)
        elif first is not None:
            self._wake(first)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(timerValues.getCurrentWatermarkInMs() * 1000)

    def _wake(self, first: int) -> None:
        """One timer a slot, at the first of its requests."""
        at, known = first // 1000 + 1, list(self.handle.listTimers())
        if not known or at < min(known):
            for old in known:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def _turn(self, now: int) -> Iterator[pd.DataFrame]:
        waiting = np.concatenate([np.frombuffer(x[0], np.int64).reshape(-1, 6) for x in self.pending.get()]) if self.pending.exists() else np.empty((0, 6), np.int64)
        due, left = waiting[waiting[:, 1] < now], waiting[waiting[:, 1] >= now]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(left):
            self.pending.put([(left.tobytes(),)])
            self._wake(int(left[:, 1].min()))
        else:
            self.pending.clear()
        if len(due):
            due = due[np.lexsort(due.T[::-1])]
            ends = [*(np.flatnonzero(np.diff(due[:, 0])) + 1).tolist(), len(due)]
            told = [d for a, b in zip([0, *ends], ends) for d in self.decide(int(due[a, 0]), due[a:b, 1:].tolist())]
            yield pd.DataFrame({"user": due[:, 0], "request": due[:, 2], "decision": told})

    def close(self) -> None:
        pass


def claimed(requests: DataFrame, limit: int = fixed.RECLAIMS, window: int = fixed.RECLAIM_SECONDS, late: str = "1 hour", slots: int = 512) -> DataFrame:
    """user, request, decision (claimed, same, held, moved, limited) of a stream of user, request, at, book, job, gone.

    `gone` tells whether the job's result is gone by the next request. Rows with a null user (as the one that ends a stream) only move
    the time on; null books or jobs are no requests. Users are dealt into `slots` keys.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    d = requests.select("user", "request", F.col("at").cast("timestamp").alias("at"), "book", "job", F.coalesce("gone", F.lit(False)).alias("gone")).withWatermark("at", late)
    # the condition names the time, or it would be tested before the watermark sees the row that ends the stream
    known = F.col("user").isNotNull() & F.col("request").isNotNull() & F.col("book").isNotNull() & F.col("job").isNotNull()
    d = d.where(F.when(F.col("at").isNotNull(), known)).withColumn("micros", F.unix_micros("at")).withColumn("slot", F.pmod(F.xxhash64("user"), F.lit(slots)))
    return d.groupBy("slot").transformWithStateInPandas(_Claims(limit, window), _TOLD, "Append", "EventTime")
