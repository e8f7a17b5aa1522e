"""Named queries over orders, events and customers that stand for the ledgers.

An order is a reservation (status F finalized, O reserved, P refunded; its price in cents), an
event a request or a purchase of its user, its value a duration. Nothing reads the clock: `now` is
a fixed value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import cost, ledger
from foliant.plans.text_queries import query

NOW = "2024-01-31 00:00:00"
DAY_CAP, MONTH_CAP = 150_000_000, 1_500_000_000
STATUS = {"F": "finalized", "O": "reserved", "P": "refunded"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.ceil(F.col("o_totalprice") * 100).cast("long")
    status = F.when(F.col("o_orderstatus") == "F", "finalized").when(F.col("o_orderstatus") == "O", "reserved").otherwise("refunded")
    at = F.col("o_orderdate")
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user"), status.alias("status"), cents.alias("cents"), F.floor(cents * 0.9).alias("actual"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.date_format(at, "yyyy-MM").alias("month"))


RESERVED = """r AS (SELECT o_orderkey AS id, o_custkey AS usr, CASE o_orderstatus WHEN 'F' THEN 'finalized' WHEN 'O' THEN 'reserved' ELSE 'refunded' END AS status, ceil(o_totalprice * 100)::BIGINT AS cents,
 floor(ceil(o_totalprice * 100)::BIGINT * 0.9::DOUBLE)::BIGINT AS actual, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month FROM orders)"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))


# ---- jobs ----------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT event_id, user_id, ts, round(value * 100)::BIGINT AS ms FROM events),
w AS (SELECT event_id, row_number() OVER o AS done, count(*) OVER (PARTITION BY user_id) AS total, (sum(ms) OVER l)::DOUBLE / (count(*) OVER l) AS mean FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {fixed.TIMING_WINDOW - 1} PRECEDING AND CURRENT ROW)),
c AS (SELECT *, total - done AS rest, greatest(1, least(4, total - done)) AS workers FROM w)
SELECT event_id, done::DOUBLE / total * 100 AS pct, CASE WHEN rest > 0 AND mean > 0 THEN mean * rest / workers END AS eta_ms, CASE WHEN rest > 0 AND mean > 0 THEN 60000.0::DOUBLE / mean * workers END AS chunks_per_min FROM c""")
def job_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a job; every event ends a chunk that took its value (hundredths as ms)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = w.rowsBetween(1 - fixed.TIMING_WINDOW, 0)
    ms = F.round(F.col("value") * 100).cast("long")
    e = timed(spark, sf_dir).select("event_id", F.row_number().over(w).alias("done"), F.count("*").over(Window.partitionBy("user_id")).alias("total"), (F.sum(ms).over(last) / F.count("*").over(last)).alias("mean"))
    told = cost.eta(F.col("done"), F.col("total"), F.col("mean"), F.lit(4))
    return e.select("event_id", *(c.alias(n) for n, c in told.items()))


@query("""WITH j AS (SELECT e.event_type, round(e.value * 100)::BIGINT AS ms, l.quality, l.toxic FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id)
SELECT event_type, count(*)::BIGINT AS sampled, sum(quality)::DOUBLE / nullif(count(quality), 0) AS mean_score, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS guard_failures, (count(*) - count(quality))::BIGINT AS unscored, sum(ms)::DOUBLE / count(*) / 1000 AS mean_seconds, sum(ms)::DOUBLE / 1e6 / count(*) * 433 AS usd_for_all FROM j GROUP BY event_type""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary per configuration (event type), extrapolated to a job of 433 chunks."""
    labels = _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "event_id")
    j = timed(spark, sf_dir).join(labels, "event_id", "left").withColumn("ms", F.round(F.col("value") * 100).cast("long"))
    n = F.count("*")
    return j.groupBy("event_type").agg(n.alias("sampled"), F.try_divide(F.sum("quality"), F.count("quality")).alias("mean_score"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("guard_failures"), (n - F.count("quality")).alias("unscored"), (F.sum("ms") / n / 1000).alias("mean_seconds"), (F.sum("ms") / F.lit(1e6) / n * 433).alias("usd_for_all"))


@query(f"""WITH {RESERVED}, k AS (SELECT count(*)::BIGINT AS jobs, count(*) FILTER (status = 'reserved')::BIGINT AS active, sum(cents) FILTER (status = 'finalized')::BIGINT AS library_cents, sum(cents) FILTER (status = 'reserved')::BIGINT AS active_cents FROM r)
SELECT *, least(1, active_cents::DOUBLE / 100000000) AS meter, active_cents::DOUBLE / 100000000 >= 0.8 AS warn FROM k""")
def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reservations(spark, sf_dir)
    k = r.agg(F.count("*").alias("jobs"), F.count(F.when(F.col("status") == "reserved", 1)).alias("active"), F.sum(F.when(F.col("status") == "finalized", F.col("cents"))).alias("library_cents"), F.sum(F.when(F.col("status") == "reserved", F.col("cents"))).alias("active_cents"))
    ratio = F.col("active_cents") / F.lit(100_000_000.0)
    return k.withColumn("meter", F.least(F.lit(1.0), ratio)).withColumn("warn", ratio >= 0.8)


_STATES = list(ledger.TRANSITIONS)
_STATE_SQL = "[" + ", ".join(f"'{s}'" for s in _STATES) + "]"
_LEGAL_SQL = " OR ".join(["(before IS NULL AND after = 'pending')", *(f"(before = '{s}' AND after IN ({', '.join(repr(x) for x in f)}))" for s, f in ledger.TRANSITIONS.items() if f)])


@query(f"""WITH s AS (SELECT user_id, {_STATE_SQL}[(event_id * 7 + user_id) % 7 + 1] AS after, ts, event_id FROM events), l AS (SELECT *, lag(after) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT before, after, coalesce({_LEGAL_SQL}, false) AS legal, count(*)::BIGINT AS n FROM l GROUP BY ALL""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes of jobs (users), and whether each is allowed."""
    state = F.element_at(F.array(*map(F.lit, _STATES)), ((F.col("event_id") * 7 + F.col("user_id")) % 7 + 1).cast("int"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = timed(spark, sf_dir).withColumn("after", state).withColumn("before", F.lag("after").over(w))
    legal = ledger.legal_transition(F.col("before"), F.col("after"))
    return s.groupBy("before", "after", legal.alias("legal")).agg(F.count("*").alias("n"))


@query(f"""SELECT event_id, CASE WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'event' WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 8 DAY THEN 'counter' ELSE 'keep' END AS swept,
CASE WHEN event_type = 'view' THEN 'done' ELSE 'cancelled' END AS status, CASE WHEN event_type = 'view' THEN NULL ELSE 'expired' END AS error_code, strftime(coalesce(CASE WHEN event_type = 'click' THEN ts END, TIMESTAMP '{NOW}'), '%Y-%m-%d %H:%M:%S') AS finished_at FROM events""")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sweep does to each row: pruned events and counters, expired jobs (views are done)."""
    now = F.lit(NOW).cast("timestamp")
    e = timed(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    before = lambda days: F.col("t") < now - F.make_dt_interval(F.lit(days))
    swept = F.when(before(fixed.EVENT_KEEP_DAYS), "event").when(before(fixed.RATE_KEEP_DAYS), "counter").otherwise("keep")
    done = F.col("event_type") == "view"
    finished = F.coalesce(F.when(F.col("event_type") == "click", F.col("t")), now)
    return e.select("event_id", swept.alias("swept"), F.when(done, "done").otherwise("cancelled").alias("status"), F.when(~done, "expired").alias("error_code"), F.date_format(finished, "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


@query(f"""WITH a AS (SELECT event_id, epoch(TIMESTAMP '{NOW}')::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS s FROM events)
SELECT event_id, CASE WHEN s < 10 THEN 'now' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age FROM a""")
def relative_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.col("at")
    return timed(spark, sf_dir).select("event_id", ledger.age(s).alias("age"))


@query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest (the listing's size)."""
    o = _read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""WITH memory AS (SELECT doc_id, 'running' AS status FROM labels WHERE quality = 1), disk AS (SELECT doc_id, 'done' AS status, source FROM documents)
SELECT doc_id, coalesce(m.status, d.status) AS status, coalesce(d.source, 'none') AS owner FROM disk d FULL JOIN memory m USING (doc_id)""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live state wins over the stored one; the owner comes from the store."""
    memory = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("running").alias("live"))
    disk = _read(spark, sf_dir, "documents").select("doc_id", F.lit("done").alias("stored"), "source")
    return disk.join(memory, "doc_id", "full").select("doc_id", F.coalesce("live", "stored").alias("status"), F.coalesce("source", F.lit("none")).alias("owner"))


# ---- budgets and credits -------------------------------------------------------------------


@query(f"WITH {RESERVED} SELECT id, cents FROM r WHERE status = 'reserved' AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.usr AND c.c_acctbal > 0)")
def owned_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations that may be released: their user owns them still."""
    owners = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user"))
    return reservations(spark, sf_dir).where("status = 'reserved'").join(owners, "user", "left_semi").select("id", "cents")


@query(f"""WITH {RESERVED}, moves AS (SELECT usr, 0::BIGINT AS p, CASE WHEN status = 'reserved' THEN cents ELSE 0 END AS h, CASE WHEN status = 'finalized' THEN cents ELSE 0 END AS s FROM r UNION ALL SELECT user_id, 250000, 0, 0 FROM events WHERE event_type = 'purchase')
SELECT usr AS "user", sum(p)::BIGINT AS purchased, sum(h)::BIGINT AS reserved, sum(s)::BIGINT AS spent, (sum(p) - sum(h) - sum(s))::BIGINT AS balance FROM moves GROUP BY usr""")
def credit_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("user"), F.lit(250_000).cast("long").alias("credits"))
    held = reservations(spark, sf_dir).select("user", F.col("cents").alias("credits"), "status")
    return ledger.balances(bought, held)


@query(f"WITH {RESERVED} SELECT usr AS \"user\", coalesce(sum(cents) FILTER (status = 'reserved'), 0)::BIGINT AS reserved, coalesce(sum(cents) FILTER (status = 'finalized'), 0)::BIGINT AS spent FROM r GROUP BY usr")
def credit_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances from signed changes, which agree with those from states."""
    return ledger.deltas(reservations(spark, sf_dir).select("user", F.col("cents").alias("credits"), "status"))


@query(f"WITH {RESERVED} SELECT month, day, sum(CASE status WHEN 'finalized' THEN actual WHEN 'reserved' THEN cents ELSE 0 END)::BIGINT AS used_cents, count(*)::BIGINT AS n FROM r GROUP BY ROLLUP (month, day)")
def budget_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.budget_rollup(reservations(spark, sf_dir))


_FITS = f"(CASE WHEN s.day = a.day THEN a.day_used ELSE 0 END) + s.cents <= {DAY_CAP} AND a.used + s.cents <= {MONTH_CAP}"


@query(f"""WITH RECURSIVE {RESERVED}, s AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY day, id) AS seq FROM r),
a AS (SELECT id, month, seq, day, cents <= {DAY_CAP} AND cents <= {MONTH_CAP} AS admitted, CASE WHEN cents <= {DAY_CAP} THEN cents ELSE 0 END AS day_used, CASE WHEN cents <= {DAY_CAP} THEN cents ELSE 0 END AS used FROM s WHERE seq = 1
UNION ALL SELECT s.id, s.month, s.seq, s.day, {_FITS}, (CASE WHEN s.day = a.day THEN a.day_used ELSE 0 END) + CASE WHEN {_FITS} THEN s.cents ELSE 0 END, a.used + CASE WHEN {_FITS} THEN s.cents ELSE 0 END FROM a JOIN s ON s.month = a.month AND s.seq = a.seq + 1)
SELECT id, admitted FROM a""")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reservations(spark, sf_dir).select("id", "month", "day", "cents")
    return ledger.admit_budget(r, "month", "day", ["id"], "cents", DAY_CAP, MONTH_CAP).select("id", "admitted")


@query("""WITH RECURSIVE m AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 250 ELSE 0 END AS g, CASE WHEN event_type IN ('click', 'view') THEN 200 END AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
f AS (SELECT event_id, user_id, seq, CASE WHEN w IS NULL THEN NULL ELSE w <= g END AS reserved, g - CASE WHEN coalesce(w, 0) <= g THEN coalesce(w, 0) ELSE 0 END AS rest FROM m WHERE seq = 1
UNION ALL SELECT m.event_id, m.user_id, m.seq, CASE WHEN m.w IS NULL THEN NULL ELSE m.w <= f.rest + m.g END, f.rest + m.g - CASE WHEN coalesce(m.w, 0) <= f.rest + m.g THEN coalesce(m.w, 0) ELSE 0 END FROM f JOIN m ON m.user_id = f.user_id AND m.seq = f.seq + 1)
SELECT event_id, reserved FROM f""")
def credit_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases grant credits, clicks and views want some: reserved only if they are there."""
    e = timed(spark, sf_dir)
    m = e.select("event_id", "user_id", F.col("ts"), F.when(F.col("event_type") == "purchase", 250).otherwise(0).cast("long").alias("grant"), F.when(F.col("event_type").isin("click", "view"), 200).cast("long").alias("want"))
    return ledger.reserve_credits(m, "user_id", ["ts", "event_id"], "grant", "want").select("event_id", "reserved")


@query("""WITH e AS (SELECT event_id, user_id, (floor(epoch(ts))::BIGINT // 3600) * 3600 AS bucket, ts FROM events)
SELECT event_id, bucket, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) <= 2 AS allowed FROM e""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rate_limited(timed(spark, sf_dir), "user_id", "at", ["ts", "event_id"], 2, 3600).select("event_id", "bucket", "allowed")


#: A user's requests one after another: who holds each book, and the moves of the week.
CLAIMS_SQL = f"""WITH RECURSIVE m AS (SELECT event_id, user_id, event_id % 7 AS book, value < 250 AS gone, floor(epoch(ts))::BIGINT // {fixed.RECLAIM_SECONDS} AS week, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 s AS (SELECT user_id, 0::BIGINT AS i, MAP {{}}::MAP(BIGINT, STRUCT(job BIGINT, gone BOOLEAN)) AS held, NULL::BIGINT AS week, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS decision FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, i, CASE WHEN decision IN ('claimed', 'moved') THEN map_concat(held, MAP {{book: {{'job': event_id, 'gone': gone}}}}) ELSE held END, CASE WHEN decision = 'moved' THEN week ELSE before END, CASE WHEN decision = 'moved' THEN used + 1 ELSE n END, event_id, decision
  FROM (SELECT *, CASE WHEN h IS NULL THEN 'claimed' WHEN NOT h.gone THEN 'held' WHEN used >= {fixed.RECLAIMS} THEN 'limited' ELSE 'moved' END AS decision
   FROM (SELECT m.*, s.held, s.n, s.week AS before, s.held[m.book] AS h, CASE WHEN s.week = m.week THEN s.n ELSE 0 END AS used FROM s JOIN m ON m.user_id = s.user_id AND m.i = s.i + 1)))
SELECT event_id, decision FROM s WHERE i > 0"""


@query(CLAIMS_SQL)
def preview_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the free sample of seven books; small values are results that are gone."""
    e = timed(spark, sf_dir).select("event_id", "user_id", "ts", "at", (F.col("event_id") % 7).alias("book"), (F.col("value") < 250).alias("gone"))
    return ledger.claim_previews(e, "user_id", "book", "event_id", ["ts", "event_id"], "at", "gone").select("event_id", "decision")


# ---- purchases and accounts ----------------------------------------------------------------


@query("""WITH p AS (SELECT event_id, event_id % 97 AS tx, user_id % 3 AS usr, event_id % 2 AS book, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT *, row_number() OVER w AS rn, first_value((usr, book)) OVER w AS first FROM p WINDOW w AS (PARTITION BY tx ORDER BY ts, event_id))
SELECT event_id, CASE WHEN rn = 1 THEN 'applied' WHEN (usr, book) = first THEN 'replay' ELSE 'conflict' END AS outcome FROM f""")
def purchase_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "ts", (F.col("event_id") % 97).alias("tx"), (F.col("user_id") % 3).alias("usr"), (F.col("event_id") % 2).alias("book"))
    return ledger.classify_purchases(p, "tx", ["usr", "book"], ["ts", "event_id"]).select("event_id", "outcome")


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'environment' WHEN event_id % 13 = 0 THEN 'bundle' WHEN event_id % 5 = 0 THEN 'type' WHEN event_id % 7 = 0 THEN 'revoked' WHEN user_id % 10 = 0 THEN 'account' WHEN event_id % 3 = 0 THEN 'tier' END AS reason FROM events WHERE event_type = 'purchase'""")
def purchase_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, hit = F.col("event_id"), lambda n: F.col("event_id") % n == 0
    p = _read(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        i,
        F.when(hit(11), "Sandbox").otherwise("Production").alias("environment"),
        F.when(hit(13), "other").otherwise("app").alias("bundle"),
        F.when(hit(5), "Subscription").otherwise("Consumable").alias("type"),
        hit(7).alias("revoked"),
        F.when(F.col("user_id") % 10 != 0, F.lit("me")).alias("account"),
        F.when(hit(3), 2).otherwise(1).alias("product"),
    )
    expected = {"production": F.lit(True), "bundle": F.lit("app"), "account": F.lit("me"), "product": F.lit(1)}
    return p.select("event_id", ledger.rejection(expected).alias("reason"))


@query("""WITH old AS (SELECT user_id, event_id % 5 AS book, min(event_id) AS id, 'grant' AS origin FROM events WHERE event_type = 'signup' GROUP BY ALL), new AS (SELECT user_id, event_id % 5 AS book, arg_min(event_id, (ts, event_id)) AS id, 'purchase' AS origin FROM events WHERE event_type = 'purchase' GROUP BY user_id, event_id % 5)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.book = new.book)""")
def entitlements_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("book", F.col("event_id") % 5)
    old = e.where("event_type = 'signup'").groupBy("user_id", "book").agg(F.min("event_id").alias("id")).withColumn("origin", F.lit("grant"))
    new = e.where("event_type = 'purchase'").select("user_id", "book", F.col("event_id").alias("id"), F.lit("purchase").alias("origin"), "ts")
    return ledger.insert_or_ignore(old, new, ["user_id", "book"], ["ts", "id"])


@query("""WITH old AS (SELECT user_id, max(strftime(ts, '%Y-%m-%d %H:%M')) AS t FROM events WHERE event_type = 'signup' GROUP BY user_id), new AS (SELECT user_id, max(strftime(ts, '%Y-%m-%d %H:%M')) AS t FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, CASE WHEN old.t IS NULL OR new.t > old.t THEN new.t ELSE old.t END AS last_login FROM old FULL JOIN new USING (user_id)""")
def last_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert: a login replaces the stored one when it is later."""
    e = _read(spark, sf_dir, "events")
    at = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max(F.date_format("ts", "yyyy-MM-dd HH:mm")).alias("last_login"))
    return ledger.upsert(at("signup"), at("click"), "user_id", "last_login", lambda old, new: new > old)


_CHECKS = {"order_id_positive": "o_orderkey > 0", "status_known": "o_orderstatus IN ('F', 'O', 'P')", "price_not_negative": "o_totalprice >= 0", "price_below_cap": "o_totalprice <= 300000", "priority_length": "length(o_orderpriority) BETWEEN 1 AND 10"}


@query("SELECT name, n FROM (SELECT " + ", ".join(f"count(*) FILTER (NOT ({c}))::BIGINT AS {n}" for n, c in _CHECKS.items()) + " FROM orders) UNPIVOT (n FOR name IN (" + ", ".join(_CHECKS) + "))")
def ledger_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that violate each constraint, counted in one scan."""
    o = _read(spark, sf_dir, "orders").agg(*(F.count(F.when(~F.expr(c), 1)).alias(n) for n, c in _CHECKS.items()))
    return o.select(F.explode(F.create_map(*(x for n in _CHECKS for x in (F.lit(n), F.col(n))))).alias("name", "n"))


_EXPORT = [("account", "customer", "c_custkey", "c_name"), ("reservation", "orders", "o_custkey", "cast(o_orderkey AS {s})"), ("event", "events", "user_id", "cast(event_id AS {s})")]


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, {user} AS usr, {value.format(s='VARCHAR')} AS value FROM {table} WHERE {user} = 7" for kind, table, user, value in _EXPORT))
def account_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the stores hold of one account; the filter reaches every scan."""
    out = None
    for kind, table, user, value in _EXPORT:
        part = _read(spark, sf_dir, table).where(F.col(user) == 7).select(F.lit(kind).alias("kind"), F.col(user).alias("usr"), F.expr(value.format(s="STRING")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) SELECT 'orders' AS store, count(*)::BIGINT AS kept FROM orders WHERE o_custkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'events', count(*)::BIGINT FROM events WHERE user_id NOT IN (SELECT k FROM gone)")
def account_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay in each store once accounts are deleted."""
    gone = _read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("store"))
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.lit("events").alias("store"))
    return orders.unionByName(events).join(gone, "k", "left_anti").groupBy("store").agg(F.count("*").alias("kept"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return e.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("users"))


@query("""SELECT event_id, substr(sha256(user_id::VARCHAR), 1, 16) AS usr, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS token FROM (SELECT *, sha256(event_id::VARCHAR) AS h FROM events)""")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", T.pseudonym(F.col("user_id")).alias("usr"), T.uuid_of(F.sha2(F.col("event_id").cast("string"), 256)).alias("token"))


_RELEASES = [("v1", "2023-12-01 00:00:00"), ("v2", "2024-01-10 00:00:00"), ("v3", "2024-01-20 00:00:00"), ("v4", "soon")]
HONOURED = ["rights-2", "rights-1"]  # statements: the current one and the superseded ones that still count


@query(f"""WITH rel(version, since) AS (VALUES {", ".join(f"('{v}', '{t}')" for v, t in _RELEASES)}), a AS (SELECT event_id, 'v' || (event_id % 5 + 1) AS version, CASE WHEN event_id % 10 = 3 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS said,
 CASE WHEN event_id % 6 = 0 THEN 'web' ELSE 'ios-clickwrap' END AS method, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE 'hu-HU' END AS locale, 'rights-' || event_id % 4 AS statement, CASE WHEN event_id % 8 = 0 THEN 'nope' ELSE regexp_replace(md5(event_id::VARCHAR), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-') END AS id FROM events)
SELECT event_id, a.version, coalesce(regexp_full_match(id, '(?i){fixed.UUID}') AND method = 'ios-clickwrap' AND regexp_full_match(locale, '(?i){fixed.LOCALE}') AND statement IN ('rights-2', 'rights-1') AND TRY_CAST(said AS TIMESTAMP) IS NOT NULL AND TRY_CAST(since AS TIMESTAMP) IS NOT NULL
 AND TRY_CAST(said AS TIMESTAMP) >= TRY_CAST(since AS TIMESTAMP) AND TRY_CAST(said AS TIMESTAMP) <= TIMESTAMP '2024-01-25 00:00:00' + INTERVAL {fixed.MAX_CLOCK_SKEW_SECONDS} SECOND, false) AS valid FROM a LEFT JOIN rel ON rel.version = a.version""")
def terms_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptances against the release they name: id, locale, method, statement and dates must be in order,
    the release in force and the acceptance not in the future."""
    releases = spark.createDataFrame(_RELEASES, "version string, since string").select("version", F.col("since").try_cast("timestamp").alias("since"))
    i = F.col("event_id")
    uuid = F.when(i % 8 == 0, "nope").otherwise(T.uuid_of(F.md5(i.cast("string").cast("binary"))))
    at = F.when(i % 10 == 3, "yesterday").otherwise(F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).try_cast("timestamp")
    a = timed(spark, sf_dir).select(i, F.concat(F.lit("v"), (i % 5 + 1).cast("string")).alias("version"), at.alias("t"), F.when(i % 6 == 0, "web").otherwise("ios-clickwrap").alias("method"), F.when(i % 9 == 0, "x").otherwise("hu-HU").alias("locale"), F.concat(F.lit("rights-"), (i % 4).cast("string")).alias("statement"), uuid.alias("id"))
    joined = a.join(F.broadcast(releases), "version", "left")
    return joined.select("event_id", "version", ledger.valid_acceptance(F.lit("2024-01-25 00:00:00").cast("timestamp"), HONOURED).alias("valid"))


_PAIR_SQL = ", ".join(f"('{s}', '{t}', {str(v).upper()}, {a}::DOUBLE, {b}::DOUBLE)" for s, t, v, a, b, _, _ in fixed.PAIRS)


@query(f"""WITH pairs(src, dst, validated, low, high) AS (VALUES {_PAIR_SQL}), asked AS (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY lang)
SELECT lang, dst.d AS target, n, coalesce(low, 0.85) AS low, coalesce(high, 1.5) AS high, coalesce(validated, false) AS open FROM asked, (VALUES ('hu'), ('de'), ('es')) dst(d) LEFT JOIN pairs ON src = lang AND dst = dst.d""".replace("dst = dst.d", "pairs.dst = dst.d"))
def pair_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by language pair, its healthy band or the default, and whether the pair is open."""
    asked = _read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.explode(F.array(*map(F.lit, ("hu", "de", "es")))).alias("target"), "n")
    pairs = spark.createDataFrame([p[:5] for p in fixed.PAIRS], "lang string, target string, validated boolean, low double, high double")
    joined = asked.join(F.broadcast(pairs), ["lang", "target"], "left")
    return joined.select("lang", "target", "n", F.coalesce("low", F.lit(0.85)).alias("low"), F.coalesce("high", F.lit(1.5)).alias("high"), F.coalesce("validated", F.lit(False)).alias("open"))
