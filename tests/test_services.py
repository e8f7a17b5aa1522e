"""Gated queues, published results and expiry, over several batches and through failures."""

import heapq
import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.streaming import claims, gate, publish, sweep
from foliant.streaming.stream_queries import to_table

START = datetime(2024, 1, 1)
MESSAGE = "queue string, message long, at timestamp_ntz, seconds long"
RULES = gate.Gate(slots=2, retry_seconds=60, retries=3)


def batches(spark, parts, schema, path, work):
    """work's stream over parts, a file and a run each; what each run told, up to the watermark that it left."""
    told = []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        seen = {r for b in told for r in b}
        rows = {tuple(r) for r in to_table(work(stream), at=f"{path}/out").collect()}
        told.append(rows - seen)
    return told


def by_the_book(rows, rules):
    out = []
    for q in {r[0] for r in rows}:
        agenda = [(at, at, m, 0, s) for k, m, at, s in rows if k == q]
        heapq.heapify(agenda)
        busy = []
        while agenda:
            at, asked, m, n, s = heapq.heappop(agenda)
            busy = [b for b in busy if b > at]
            if len(busy) < rules.slots:
                busy.append(at + timedelta(seconds=s))
                out.append((q, m, "started", n, at))
            elif n < rules.retries:
                heapq.heappush(agenda, (at + timedelta(seconds=rules.retry_seconds), asked, m, n + 1, s))
            else:
                out.append((q, m, "dead", n, at))
    return sorted(out)


def test_gate_over_batches_equals_one_sequence(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, START + timedelta(seconds=20 * i + rng.randrange(20)), rng.randrange(0, 400)) for i in range(120)]
    rows += [("a", 500 + i, START + timedelta(seconds=900), 50) for i in range(4)]  # at once: by id
    rows.sort(key=lambda r: r[2])
    end = [(gate.END, 0, START + timedelta(days=1), 0)]
    parts = [rows[:40], rows[40:80], rows[80:], end]
    told = batches(spark, parts, MESSAGE, tmp_path, lambda s: gate.gated(s, RULES, "10 minutes").withColumn("at", F.col("at").cast("timestamp_ntz")))
    want = by_the_book(rows, RULES)
    assert sorted(r for b in told for r in b) == want and {r[2] for r in want} == {"started", "dead"}
    assert told[1] and told[2]  # decided as time went by, not only at the end


def by_the_clock(spark, rows, schema, path, work, n):
    """The first n rows of work's stream over the rows; a stream that goes by the clock never ends by itself."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in")
    told = []
    stream = work(spark.readStream.schema(schema).parquet(f"{path}/in"))
    running = stream.writeStream.foreachBatch(lambda batch, _: told.extend(map(tuple, batch.collect()))).option("checkpointLocation", f"{path}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while len(told) < n and time.time() < until:
            assert not running.awaitTermination(1)
        assert not running.awaitTermination(3)
    finally:
        running.stop()
    return sorted(told)


def test_gate_by_the_clock(spark, tmp_path):
    rows = [("q", i, START, 3600) for i in range(4)] + [(None, 9, START, 1), ("q", None, START, 1)]
    told = by_the_clock(spark, rows, MESSAGE, tmp_path, lambda s: gate.gated(s, gate.Gate(slots=3, event_time=False)), 3)
    assert [r[1:3] for r in told] == [(0, "started"), (1, "started"), (2, "started")]  # the fourth waits a minute


def test_attempts_keep_what_is_not_due():
    waiting = [(100, 100, 1, 0, 50), (200, 200, 2, 0, 0)]
    busy = []
    assert gate.attempts(waiting, busy, gate.Gate(), 150) == [(1, "started", 0, 100)]
    assert waiting == [(200, 200, 2, 0, 0)] and busy == [150]


def test_a_queue_is_read_from_its_state_chunk_by_chunk(spark, tmp_path, monkeypatch):
    """all messages that waited were rows of one Python list."""
    class Chunks(dict):
        def updateValue(self, key, value):
            self[key] = value

        getValue = dict.get
        removeKey = dict.pop

    class Rows(list):
        exists = lambda self: bool(self)
        get = lambda self: list(self)

        def put(self, rows):
            self[:] = rows

    class Handle:
        getMapState = lambda self, *a: Chunks()
        getListState = lambda self, *a: Rows()
        listTimers = lambda self: []
        registerTimer = deleteTimer = lambda self, at: None

    class Times:
        getCurrentProcessingTimeInMs = lambda self: 0
        getCurrentWatermarkInMs = lambda self: self.now

    monkeypatch.setattr(gate, "_CHUNK", 16)
    monkeypatch.setattr(gate, "_HELD", 100)
    most, tried = [0], gate.attempts
    monkeypatch.setattr(gate, "attempts", lambda waiting, *a: (most.append(len(waiting)), tried(waiting, *a))[1])
    rng = random.Random(3)
    rows = [("q", i, START + timedelta(seconds=rng.randrange(100_000)), rng.randrange(900)) for i in range(1000)]
    micros = lambda at: int((at - START).total_seconds()) * 1_000_000
    queue, times, told = gate._Queue(RULES), Times(), []
    queue.init(Handle())
    frames = [pd.DataFrame([(m, micros(at), s * 1_000_000) for _, m, at, s in rows[i : i + 50]], columns=["message", "asked", "work"]) for i in range(0, 1000, 50)]
    for times.now, turn in ((0, lambda: queue.handleInputRows(("q",), iter(frames), times)), (50_000_500, lambda: queue.handleExpiredTimer(("q",), times, None)), (10**9, lambda: queue.handleExpiredTimer(("q",), times, None))):
        told += [r for f in turn() for r in f.itertuples(index=False, name=None)]
    assert sorted((q, m, o, n, START + timedelta(microseconds=at)) for q, m, o, n, at in told) == by_the_book(rows, RULES)
    assert 0 < max(most) <= 220 and not queue.chunks and not queue.begins  # a chunk of each of ten runs, and what comes back


RECORD = "subject long, kind string, row long, at timestamp_ntz"


def test_rows_expire_in_the_batch_in_which_their_time_passes(spark, tmp_path):
    day = lambda n, h=0: START + timedelta(days=n, hours=h)
    parts = [
        [(1, "short", 1, day(0)), (1, "short", 2, day(0, 5)), (2, "long", 3, day(0)), (1, "ever", 4, day(0)), (None, "short", 5, day(0))],
        [(1, "short", 6, day(2, 3))],  # moves the time to day 2, 2 h: row 1 is gone, row 2 not yet
        [(1, "short", 7, day(2, 7))],
        [(0, gate.END, 0, day(9))],
    ]
    told = batches(spark, parts, RECORD, tmp_path, lambda s: sweep.expired(s, {"short": 2, "long": 5}).withColumn("expired_at", F.col("expired_at").cast("timestamp_ntz")))
    assert [sorted(r[2] for r in b) for b in told] == [[], [1], [2], [3, 6, 7]]
    assert {r[2]: r[3] for b in told for r in b}[6] == day(4, 3)


def test_many_subjects_are_few_keys_of_state(spark, tmp_path):
    """A key of its own for each subject cost calls to the state a subject: 4.8 million of them took hours."""
    spark.createDataFrame([(i, "short", i, START + timedelta(seconds=i)) for i in range(600)], RECORD).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = sweep.expired(spark.readStream.schema(RECORD).parquet(f"{tmp_path}/in"), {"short": 2}, slots=4)
    running = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    kept = max(op["numRowsTotal"] for p in running.recentProgress for op in p["stateOperators"])
    assert 0 < kept <= 60  # 600 and more before: four slots, each with its rows, its timer and what counts them


def test_seen_once_by_time_to_live(spark, tmp_path):
    part = [(1, "a", 1, START), (1, "a", 2, START), (2, "a", 3, START)]
    told = by_the_clock(spark, part, RECORD, tmp_path, lambda s: sweep.seen_once(s, 3600), 2)
    assert told == [(1, "a"), (2, "a")]


REQUEST = "user long, request long, at timestamp_ntz, book long, job long, gone boolean"


def test_claims_over_batches_equal_one_sequence(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.randrange(3), i, START + timedelta(hours=6 * i + rng.randrange(6)), rng.randrange(3), rng.randrange(40), rng.random() < 0.8) for i in range(150)]
    rows.sort(key=lambda r: r[2])
    swapped = [*rows[:49], rows[50], rows[49], *rows[51:]]  # one comes late by less than is waited for
    parts = [swapped[:50], swapped[50:100], swapped[100:], [(None, None, START + timedelta(days=90), None, None, None)]]
    told = batches(spark, parts, REQUEST, tmp_path, lambda s: claims.claimed(s, limit=2, window=7 * 86400, late="2 days"))
    held, moves, want = {}, {}, {}
    for user, request, at, book, job, gone in sorted(rows, key=lambda r: (r[2], r[1])):
        now = held.get((user, book))
        week = user, int((at - datetime(1970, 1, 1)).total_seconds()) // (7 * 86400)
        if now and now[0] != job:
            want[request] = "held" if not now[1] else "limited" if moves.get(week, 0) >= 2 else "moved"
            moves[week] = moves.get(week, 0) + (want[request] == "moved")
        else:
            want[request] = "same" if now else "claimed"
        if want[request] in ("claimed", "same", "moved"):
            held[user, book] = (job, gone)
    assert {r[1]: r[2] for b in told for r in b} == want and {"claimed", "held", "moved", "limited"} <= set(want.values())


def test_many_users_are_few_keys_of_claims(spark, tmp_path):
    """a key a user, and calls to the state for each request."""
    spark.createDataFrame([(i, i, START + timedelta(seconds=i), 1, i, True) for i in range(600)], REQUEST).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = claims.claimed(spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in"), slots=4)
    running = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    kept = max(op["numRowsTotal"] for p in running.recentProgress for op in p["stateOperators"])
    assert 0 < kept <= 60


OUTCOME = "job long, message long, at timestamp, usr long, book string, sample boolean, done boolean, usd double"


class Killed(Exception):
    pass


def outcomes(spark, rows, path):
    spark.createDataFrame(rows, OUTCOME).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("point", ["results", "settlements", "entitlements", "ledger"])
def test_a_batch_that_dies_halfway_publishes_once(spark, tmp_path, point):
    """The second epoch is killed after each of its steps in turn, and run again from the same checkpoint."""
    first = [(1, 1, START, 7, "b", False, True, 0.101), (1, 2, START, 7, "b", False, False, 9.0), (2, 3, START, 7, "b", True, True, 1.0)]
    second = [(3, 4, START, 7, "b", False, True, 2.0), (1, 1, START, 7, "b", False, True, 0.101), (4, 5, START, 8, "c", False, False, 3.0), (None, 6, START, 8, "c", False, True, 3.0)]
    path, state = f"{tmp_path}/in", f"{tmp_path}/state"
    publish.run(outcomes(spark, first, path), publish.job_sink(f"{tmp_path}/t"), state)
    stream = outcomes(spark, second, path)

    def die(done, epoch):
        if (done, epoch) == (point, 1):
            raise Killed

    with pytest.raises(Exception):
        publish.run(stream, publish.job_sink(f"{tmp_path}/t", die), state)
    sink = publish.job_sink(f"{tmp_path}/t")
    seen = sink.table(spark, "results").count()
    assert seen == (4 if point == "ledger" else 2)  # all or nothing of the epoch
    publish.run(stream, sink, state)
    publish.run(stream, sink, state)
    rows = lambda t: sorted(map(tuple, sink.table(spark, t).collect()))
    assert rows("results") == [(1, 1, 7, "b", "done"), (2, 3, 7, "b", "done"), (3, 4, 7, "b", "done"), (4, 5, 8, "c", "error")]
    assert rows("settlements") == [(1, "finalized", 11), (2, "finalized", 100), (3, "finalized", 200), (4, "refunded", 0)]
    assert rows("entitlements") == [(7, "b", 1)]


def test_nothing_published_yet(spark, tmp_path):
    assert publish.job_sink(f"{tmp_path}/none").table(spark, "results").collect() == []
