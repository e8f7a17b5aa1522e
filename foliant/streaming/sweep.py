"""Retention by state: rows are held until their time has passed, and leave as expired.

Each kind of row is kept for so many days. What is held lies in the state of (kind, day of the row, slot by the row's id), packed, so that a subject with
very many rows is split and very many subjects are no more keys: each key costs calls to its state, a row in it next to nothing. A key sleeps until
a timer at the first moment at which one of its rows is too old by event time, gives out all rows that are, and is removed with its last
one. Time is the watermark, never the clock, so runs agree.

Spark's own time to live of a state counts from the clock of the tasks and drops silently; `seen_once` uses it where
that is wanted: a key is told once, and again only after it has been quiet for as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliant.streaming.gate import _ROCKS, END

_GONE = "subject long, kind string, row long, micros long"


class _Held(StatefulProcessor):
    def __init__(self, keep: dict[str, int]):
        self.keep = keep  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")  # (until, row, subject) of many rows

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            fresh = np.stack([part["micros"].to_numpy(np.int64) + self.keep[key[0]], part["row"].to_numpy(np.int64), part["subject"].to_numpy(np.int64)], axis=1)
            stay = fresh[fresh[:, 0] >= now]
            if len(stay):
                self.rows.appendList([(stay.tobytes(),)])
                self._wake(int(stay[:, 0].min()))
            yield from self._told(key, fresh[fresh[:, 0] < now])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.concatenate([np.frombuffer(x[0], np.int64).reshape(-1, 3) for x in self.rows.get()])
        stay = held[held[:, 0] >= now]
        if len(stay):
            self.rows.put([(stay.tobytes(),)])
            self._wake(int(stay[:, 0].min()))
        else:
            self.rows.clear()
        yield from self._told(key, held[held[:, 0] < now])

    def _wake(self, until: int) -> None:
        """One timer a key, at the first of its rows."""
        at, known = until // 1000 + 1, list(self.handle.listTimers())
        if not known or at < min(known):
            for old in known:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def _told(self, key: Any, gone: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(gone):
            gone = gone[np.lexsort((gone[:, 1], gone[:, 0]))]
            yield pd.DataFrame({"subject": gone[:, 2], "kind": key[0], "row": gone[:, 1], "micros": gone[:, 0]})

    def close(self) -> None:
        pass


def expired(rows: DataFrame, keep_days: dict[str, int], late: str = "1 hour", slots: int = 16) -> DataFrame:
    """subject, kind, row, expired_at of the rows of a stream (subject, kind, row, at), each in the batch in which its time passes.

    Kinds that are not named are kept for ever and so not held; a row of kind END only moves the time on. Null subjects, kinds,
    ids or times are not held. The rows of a kind and day are dealt into `slots` keys by their ids.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    d = rows.select("subject", "kind", "row", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    # the condition names the time, or it would be tested before the watermark sees the row that ends the stream
    held = F.col("kind").isin(list(keep_days)) & (F.col("kind") != END) & F.col("subject").isNotNull() & F.col("row").isNotNull()
    d = d.where(F.when(F.col("at").isNotNull(), held))
    d = d.select("kind", F.to_date("at").alias("day"), F.pmod(F.xxhash64("row"), F.lit(slots)).alias("slot"), "subject", "row", "at", F.unix_micros("at").alias("micros"))
    gone = d.groupBy("kind", "day", "slot").transformWithStateInPandas(_Held({k: n * 86_400_000_000 for k, n in keep_days.items()}), _GONE, "Append", "EventTime")
    return gone.select("subject", "kind", "row", F.timestamp_micros("micros").alias("expired_at"))


class _Once(StatefulProcessor):
    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", self.quiet_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, known = sum(len(part) for part in rows), self.seen.exists()
        self.seen.update(((self.seen.get()[0] if known else 0) + n,))  # starts its time to live again
        if not known:
            yield pd.DataFrame([key], columns=["subject", "kind"])

    def close(self) -> None:
        pass


def seen_once(rows: DataFrame, quiet_seconds: int) -> DataFrame:
    """(subject, kind) when it is first seen, and again when it comes after it was quiet for so long by the clock."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return rows.select("subject", "kind").groupBy("subject", "kind").transformWithStateInPandas(_Once(quiet_seconds * 1000), "subject long, kind string", "Append", "ProcessingTime")
