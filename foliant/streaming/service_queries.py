"""Streams of a service: gated queues, published results, expiring records.

Events stand for messages. Each query lays them out as files, runs all there is, and equals a batch twin in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.plans.ledger_queries import CLAIMS_SQL
from foliant.plans.text_queries import query
from foliant.sources import store
from foliant.streaming import claims, gate, publish, sweep
from foliant.streaming.stream_queries import to_table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _files(rows: DataFrame, name: str) -> str:
    path = store.folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return path


def _run_out(rows: DataFrame, kind: str, days: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work makes of a stream over the rows, until so many days after the last."""
    spark, path = rows.sparkSession, _files(rows, "rows")
    last = rows.agg((F.max("at") + F.expr(f"INTERVAL {days} DAYS")).alias("at"), F.lit(gate.END).alias(kind)).where("at is not null")
    end = last.select(*(F.col(f.name) if f.name in ("at", kind) else F.lit(0).cast(f.dataType).alias(f.name) for f in rows.schema))
    end.write.mode("append").parquet(path)
    return to_table(work(spark.readStream.schema(rows.schema).parquet(path)))


# ---- the gate ------------------------------------------------------------------------------

_WORK = 20  # seconds a unit of value
_RETRY = fixed.RETRY_SECONDS * 1_000_000
_HEAD = "(CASE WHEN len(s.waiting) > 0 AND (e.due IS NULL OR s.waiting[1] < {'due': e.due, 'asked': e.due, 'message': e.event_id, 'retries': 0::BIGINT, 'work': e.work}) THEN s.waiting[1] ELSE {'due': e.due, 'asked': e.due, 'message': e.event_id, 'retries': 0::BIGINT, 'work': e.work} END)"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS queue, event_id, epoch_us(ts)::BIGINT AS due, floor(value * {_WORK})::BIGINT * 1000000 AS work, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
 s AS (SELECT queue, 1::BIGINT AS i, []::STRUCT(due BIGINT, asked BIGINT, message BIGINT, retries BIGINT, work BIGINT)[] AS waiting, []::BIGINT[] AS busy, NULL::BIGINT AS message, NULL::VARCHAR AS outcome, NULL::BIGINT AS retries, NULL::BIGINT AS due FROM (SELECT DISTINCT queue FROM e)
  UNION ALL SELECT queue, i, CASE WHEN fits OR h.retries = {fixed.MAX_RETRIES} THEN rest ELSE list_sort(list_append(rest, {{'due': h.due + {_RETRY}, 'asked': h.asked, 'message': h.message, 'retries': h.retries + 1, 'work': h.work}})) END,
   CASE WHEN fits THEN list_append(free, h.due + h.work) ELSE free END, h.message, CASE WHEN fits THEN 'started' WHEN h.retries = {fixed.MAX_RETRIES} THEN 'dead' END, h.retries, h.due
  FROM (SELECT *, len(free) < {fixed.MAX_ACTIVE_JOBS} AS fits FROM (SELECT queue, h, CASE WHEN again THEN i ELSE i + 1 END AS i, CASE WHEN again THEN waiting[2:] ELSE waiting END AS rest, list_filter(busy, lambda u: u > h.due) AS free
   FROM (SELECT s.queue, s.i, s.waiting, s.busy, {_HEAD} AS h, len(s.waiting) > 0 AND {_HEAD} = s.waiting[1] AS again FROM s LEFT JOIN e ON e.queue = s.queue AND e.i = s.i WHERE e.due IS NOT NULL OR len(s.waiting) > 0))))
SELECT queue, message, outcome, retries::INTEGER AS retries, make_timestamp(due) AS "at" FROM s WHERE outcome IS NOT NULL""")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks its type's queue for one of four slots and works for a time by its value."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("queue"), F.col("event_id").alias("message"), "at", F.floor(F.col("value") * _WORK).alias("seconds"))
    return _run_out(e, "queue", 1, gate.gated).select("queue", "message", "outcome", "retries", F.col("at").cast("timestamp_ntz").alias("at"))


# ---- published results ---------------------------------------------------------------------


@query("""WITH m AS (SELECT event_id AS message, event_id // 3 AS job, ts, user_id AS usr, 'b' || user_id % 7 AS book, (event_id // 3) % 10 = 0 AS sample, event_type <> 'error' AS done, value / 100 AS usd FROM events),
 f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts, message) = 1),
 t AS (SELECT job FROM f WHERE done AND NOT sample QUALIFY row_number() OVER (PARTITION BY usr, book ORDER BY ts, message) = 1)
SELECT job, message, usr, book, CASE WHEN done THEN 'done' ELSE 'error' END AS status, CASE WHEN done THEN 'finalized' ELSE 'refunded' END AS settled, CASE WHEN done THEN greatest(0, ceil(usd * 100))::BIGINT ELSE 0 END AS cents, t.job IS NOT NULL AS entitles FROM f LEFT JOIN t USING (job)""")
def stream_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of jobs, three messages each, all delivered twice: results, settlements and entitlements appear once."""
    i, u = F.col("event_id"), F.col("user_id")
    job = F.floor(i / 3)
    book = F.concat(F.lit("b"), (u % 7).cast("string"))
    m = _events(spark, sf_dir).select(job.alias("job"), i.alias("message"), "at", u.alias("usr"), book.alias("book"), (job % 10 == 0).alias("sample"), (F.col("event_type") != "error").alias("done"), (F.col("value") / 100).alias("usd"))
    path, at = _files(m, "outcomes"), store.folder(spark, "published")
    sink = publish.job_sink(f"{at}/tables")
    for _ in range(2):
        publish.run(spark.readStream.schema(m.schema).parquet(path), sink, f"{at}/state")
        m.write.mode("append").parquet(path)
    results, settled, titles = (sink.table(spark, t) for t in ("results", "settlements", "entitlements"))
    joined = results.join(settled.withColumnRenamed("status", "settled"), "job").join(titles.select("job", F.lit(True).alias("t")), "job", "left")
    return joined.select("job", "message", "usr", "book", "status", "settled", "cents", F.coalesce("t", F.lit(False)).alias("entitles"))


# ---- claims --------------------------------------------------------------------------------


@query(CLAIMS_SQL)
def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the free sample of seven books as they stream by; small values are results that are gone."""
    i = F.col("event_id")
    e = _events(spark, sf_dir).select(F.col("user_id").alias("user"), i.alias("request"), "at", (i % 7).alias("book"), i.alias("job"), (F.col("value") < 250).alias("gone"))
    end = e.agg((F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at")).where("at is not null").select(*(F.col("at") if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema))
    path = _files(e.unionByName(end), "requests")
    told = to_table(claims.claimed(spark.readStream.schema(e.schema).parquet(path)))
    return told.select(F.col("request").alias("event_id"), "decision")


# ---- retention -----------------------------------------------------------------------------

_KEEP = {"click": fixed.RATE_KEEP_DAYS, "view": fixed.RATE_KEEP_DAYS, "error": fixed.EVENT_KEEP_DAYS, "signup": fixed.EVENT_KEEP_DAYS}


@query(f"""WITH k AS (SELECT event_id AS row, user_id AS subject, event_type AS kind, ts + CASE WHEN event_type IN ('click', 'view') THEN INTERVAL {fixed.RATE_KEEP_DAYS} DAYS ELSE INTERVAL {fixed.EVENT_KEEP_DAYS} DAYS END AS expired_at FROM events WHERE event_type <> 'purchase')
SELECT * FROM k WHERE expired_at < (SELECT max(ts) + INTERVAL 10 DAYS - INTERVAL 1 HOUR FROM events)""")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters leave after 8 days and log records after 30, purchases never; time ends ten days after the last event."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("subject"), F.col("event_type").alias("kind"), F.col("event_id").alias("row"), "at")
    return _run_out(e, "kind", 10, lambda stream: sweep.expired(stream, _KEEP)).select("subject", "kind", "row", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"))
