"""Structured Streaming queries over events. Each runs all there is (availableNow) into a table
under the session's shared folder and returns that table; each equals a batch twin in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.plans.text_queries import query
from foliant.sources import store

LIMIT, WINDOW = 2, 3600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/events.parquet"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(fs_path).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folder(spark: SparkSession) -> str:
    return store.folder(spark, "stream")


def to_table(stream: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs a stream over all there is into Parquet (exactly once) and reads it back; a folder of an earlier run goes on from there."""
    at = at or _folder(stream.sparkSession)
    writer = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state")
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def limited(stream: DataFrame, limit: int = LIMIT, slots: int = 512) -> DataFrame:
    """event_id, user_id, bucket, allowed with the counters of each user's open windows as state.

    Users are dealt into `slots` keys, since each key costs calls, a user in it next to nothing; a null user is one by itself.
    Counters go when their window has passed by event time. Within a micro-batch requests are taken
    in order of time, between batches in order of arrival. Rows stream by: only requests
    that may still be allowed are held, `limit` a user and window at most.
    """
    by, told = ["user", "bucket"], ["event_id", "user_id", "bucket", "allowed"]

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        packed = np.frombuffer(bytes(state.get[0]), np.int64) if state.exists else np.empty(0, np.int64)
        used = pd.DataFrame(packed.reshape(-1, 3), columns=[*by, "used"])
        named = lambda rows, allowed: rows.assign(user_id=None if key[0] < 0 else rows["user"], allowed=allowed)[told]

        def split(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
            rows = rows.sort_values(["ts", "event_id"])
            before = rows[by].merge(used, "left", by)["used"].fillna(0).to_numpy()
            fits = before + rows.groupby(by, dropna=False, sort=False).cumcount().to_numpy() < limit
            return rows[fits], rows[~fits]

        first, fresh = None, []  # the earliest requests so far, as many as each window has room for; and those not looked at
        for part in parts:
            fresh.append(part)
            if first is None or sum(map(len, fresh)) >= len(first):
                first, others = split(pd.concat([first, *fresh]) if first is not None else part)
                fresh = []
                yield named(others, False)  # enough earlier ones are known
        if fresh:
            first, others = split(pd.concat([first, *fresh]))
            yield named(others, False)
        taken = first.groupby(by, as_index=False).size().rename(columns={"size": "used"})
        used = pd.concat([used, taken]).astype("int64").groupby(by, as_index=False)["used"].sum()
        end = (used["bucket"] + WINDOW) * 1000
        state.update((used[end > state.getCurrentWatermarkMs()].to_numpy(np.int64).tobytes(),))
        state.setTimeoutTimestamp(max(int(end.max()) if len(end) else 0, state.getCurrentWatermarkMs()) + 1)
        yield named(first, True)

    d = stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    seconds, user = F.unix_seconds("ts"), F.col("user_id")
    slot = F.when(user.isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(slots)))
    keyed = d.select("event_id", F.coalesce(user, F.lit(0)).cast("long").alias("user"), "ts", (seconds - F.pmod(seconds, F.lit(WINDOW))).alias("bucket"), slot.alias("slot"))
    return keyed.groupBy("slot").applyInPandasWithState(decide, "event_id long, user_id long, bucket long, allowed boolean", "packed binary", "append", GroupStateTimeout.EventTimeTimeout)


@query(f"""WITH e AS (SELECT event_id, user_id, (floor(epoch(ts))::BIGINT // {WINDOW}) * {WINDOW} AS bucket, ts FROM events)
SELECT event_id, user_id, bucket, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) <= {LIMIT} AS allowed FROM e""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_table(limited(events(spark, sf_dir)))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_waitlist_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sign-up of each user and kind; the keys seen are the state."""
    return to_table(events(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows with a watermark; an idempotent sink keeps each batch's updates and the
    last update of a window is its count."""
    stream = events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", "2 hours")
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    at = _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own folder
        batch.select(F.col("w.start").alias("hour"), "event_type", "n").write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    return rows.groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("""SELECT event_type, count(*)::BIGINT AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-22 00:00:00' GROUP BY event_type""")
def stream_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within the retention are carried over, older ones fall away as they stream by."""
    kept = to_table(events(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-22").cast("timestamp_ntz")).select("event_id", "event_type"))
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))
