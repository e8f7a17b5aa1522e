import random
from collections import Counter
from datetime import datetime, timedelta

from foliant.streaming import stream_queries as sq


def test_limiter_streams_a_hot_user_in_small_batches(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(i, 1 if i % 3 else 2, start + timedelta(seconds=rng.randrange(5 * sq.WINDOW))) for i in range(200)]
    rows += [(900 + i, 3, start) for i in range(4)]  # ties go by event_id
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz").parquet(f"{tmp_path}/in")
        got = sq.to_table(sq.limited(stream)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    used, want = Counter(), {}
    for event, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        window = user, int((ts - start).total_seconds()) // sq.WINDOW
        want[event] = used[window] < sq.LIMIT
        used[window] += 1
    assert len(got) == len(rows) and {r.event_id: r.allowed for r in got} == want


def test_many_users_of_the_limiter_are_few_keys(spark, tmp_path):
    """a key a user cost seconds by their number. A null user has a window of its own, and counters last between batches."""
    start, schema = datetime(2024, 1, 1), "event_id long, user_id long, ts timestamp_ntz"
    for k in range(2):
        rows = [(1000 * k + i, i // 2 % 300 or None, start + timedelta(seconds=k * 600 + i)) for i in range(600)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = sq.limited(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), limit=3, slots=4)
    running = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    assert 0 < max(op["numRowsTotal"] for p in running.recentProgress for op in p["stateOperators"]) <= 5
    used = Counter()
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        used[r.user_id, r.allowed] += 1
    assert used == {(u or None, a): n for u in range(300) for a, n in ((True, 3), (False, 1))}
