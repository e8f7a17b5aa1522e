"""Ledgers: balances, budgets, admission in order, claims, upserts and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import speculation

_KINDS = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}


def in_order(df: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], object], name: str, kind: str) -> DataFrame:
    """df with one more column: step(state, row) for each key's rows in order.

    For decisions that depend on earlier decisions, which no window can say. Rows stream through
    in sorted order with one state a key, so no group is ever held in memory.
    """
    dealt = df.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), {}
        for batch in batches:
            names, out = batch.schema.names, []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                if row[key] != last:
                    last, state = row[key], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _KINDS[kind])], [*names, name])

    return dealt.mapInArrow(run, StructType([*dealt.schema, StructField(name, DataType.fromDDL(kind))]))


def admit_budget(requests: DataFrame, month: str, day: str, order: list[str], cents: str, day_cap: int = fixed.DAY_CAP_CENTS, month_cap: int = fixed.MONTH_CAP_CENTS) -> DataFrame:
    """`admitted`: the request fits the day's and the month's cap; rejected ones use nothing."""

    def step(state: dict, row: dict) -> bool:
        if state.get("day") != row[day]:
            state["day"], state["day_used"] = row[day], 0
        fits = state["day_used"] + row[cents] <= day_cap and state["used"] + row[cents] <= month_cap
        if fits:
            state["day_used"] += row[cents]
            state["used"] += row[cents]
        return fits

    return in_order(requests, month, [day, *order], lambda: {"used": 0}, step, "admitted", "boolean")


def reserve_credits(moves: DataFrame, user: str, order: list[str], grant: str, want: str) -> DataFrame:
    """`reserved`: the wanted credits are covered by grants less earlier reservations (null: none wanted)."""

    def step(state: dict, row: dict) -> bool | None:
        state["left"] += row[grant] or 0
        if not row[want]:
            return None
        if row[want] > state["left"]:
            return False
        state["left"] -= row[want]
        return True

    return in_order(moves, user, order, lambda: {"left": 0}, step, "reserved", "boolean")


def budget_moves(moves: DataFrame, order: list[str], day_cap: int = fixed.DAY_CAP_CENTS, month_cap: int = fixed.MONTH_CAP_CENTS, range_rows: int = speculation.RANGE_ROWS) -> DataFrame:
    """`decision` on each move of the budget: columns day (yyyy-mm-dd), kind (ask, finalize, refund), job, cents.

    An ask is acquired (it fits the caps of its day and month), held (the job has it already, for the same
    cents), or refused; after a refund a job may ask again, for any day. A finalized job uses its actual cents, on the
    day that it asked for. A job is one job in whatever months its moves come.
    """

    def used(state: speculation.State, day: str, cents: int) -> None:
        for key in (f"d:{day}", f"m:{day[:7]}"):
            state[key] = (state[key] or 0) + cents

    def step(state: speculation.State, row: dict) -> str:
        key = f"j:{row['job']}"
        job = state[key]  # day, cents asked, whether it is open
        if row["kind"] == "ask":
            day, cents = str(row["day"]), row["cents"]
            if job:
                return "held" if job[1] == cents else "refused"
            if (state[f"d:{day}"] or 0) + cents > day_cap or (state[f"m:{day[:7]}"] or 0) + cents > month_cap:
                return "refused"
            used(state, day, cents)
            state[key] = [day, cents, True]
            return "acquired"
        if not job or not job[2]:
            return "ignored"
        if row["kind"] == "refund":
            used(state, job[0], -job[1])
            state[key] = None
            return "refunded"
        used(state, job[0], row["cents"] - job[1])
        state[key] = [job[0], job[1], False]
        return "finalized"

    return speculation.fold(moves, order, step, range_rows=range_rows)


def grant_purchases(purchases: DataFrame, transaction: str, user: str, product: str, credits: dict[str, int], at: str) -> DataFrame:
    """`decision` on each purchase: applied (the first of its transaction), repeated, rebound (the transaction
    belongs to another user or product), unknown (no such product); `credits` that it adds."""
    worth = F.lit(None).cast("long")
    for name, n in credits.items():
        worth = F.when(F.col(product) == name, F.lit(n).cast("long")).otherwise(worth)
    d = purchases.withColumn("__worth", worth)
    first = d.where("__worth is not null").groupBy(transaction).agg(F.min_by(F.struct(F.col(user).alias("u"), F.col(product).alias("p"), F.col(at).alias("t")), at).alias("__first"))
    j = d.join(first, transaction, "left")
    same = (F.col(user) == F.col("__first.u")) & (F.col(product) == F.col("__first.p"))
    decision = F.when(F.col("__worth").isNull(), "unknown").when(F.col(at) == F.col("__first.t"), "applied").when(same, "repeated").otherwise("rebound")
    return j.withColumn("decision", decision).withColumn("credits", F.when(F.col("decision") == "applied", F.col("__worth")).otherwise(0)).drop("__worth", "__first")


def credit_moves(moves: DataFrame, order: list[str], user: str = "user", range_rows: int = speculation.RANGE_ROWS) -> DataFrame:
    """`decision` on each move: columns user, kind (grant, reserve, finalize, refund), job, quote, credits.

    A reservation is reserved, repeated (it holds already), mismatched (the job was first reserved by another user, or for another
    quote or other credits), or short (the balance does not cover it, and the job stays nobody's). A refunded one may be reserved again by
    its user. Settling acts on reserved jobs only, whoever settles, and a refund goes to the user that holds the job.
    """

    def step(state: speculation.State, row: dict) -> str:
        own = f"u:{row[user]}"
        if row["kind"] == "grant":
            state[own] = (state[own] or 0) + row["credits"]
            return "granted"
        key = f"j:{row['job']}"
        job = state[key]  # user, quote, credits, status
        if row["kind"] == "reserve":
            if job and job[:3] != [row[user], row["quote"], row["credits"]]:
                return "mismatched"
            if job and job[3] != "refund":
                return "repeated"
            if row["credits"] > (state[own] or 0):
                return "short"
            state[own] = (state[own] or 0) - row["credits"]
            state[key] = [row[user], row["quote"], row["credits"], "reserve"]
            return "reserved"
        if not job or job[3] != "reserve":
            return "ignored"
        state[key] = [*job[:3], row["kind"]]
        if row["kind"] == "refund":
            holder = f"u:{job[0]}"
            state[holder] = (state[holder] or 0) + job[2]
        return "refunded" if row["kind"] == "refund" else "finalized"

    return speculation.fold(moves, order, step, range_rows=range_rows)


def owned(jobs: DataFrame, user: str, who: str) -> DataFrame:
    """Jobs of the user; what has no owner is nobody's."""
    return jobs.where(F.col(user).isNotNull() & (F.col(user) != "") & (F.col(user) == who))


def completed_translations(jobs: DataFrame) -> DataFrame:
    """The latest finished full translation of each user, source and target that still has its result."""
    done = jobs.where("sample = 0 AND status = 'done' AND result_key IS NOT NULL")
    return done.groupBy("user", "source_hash", "target").agg(F.max_by("job", F.struct("finished_at", "job")).alias("job"))


def claim_previews(requests: DataFrame, user: str, book: str, job: str, order: list[str], seconds: str, gone: str, limit: int = fixed.RECLAIMS, window: int = fixed.RECLAIM_SECONDS) -> DataFrame:
    """`decision` on a free sample of (user, book): claimed, same (the job that holds it), held
    (its result is there), moved (it is gone), or limited (too many moves in the window).

    `gone` tells of a row's job whether its result is gone by the next request.
    """

    def step(state: dict, row: dict) -> str:
        held = state["claims"].get(row[book])
        if held is None or held[0] == row[job]:
            state["claims"][row[book]] = (row[job], row[gone])
            return "claimed" if held is None else "same"
        if not held[1]:
            return "held"
        at = row[seconds] // window
        if state["at"] != at:
            state["at"], state["moves"] = at, 0
        if state["moves"] >= limit:
            return "limited"
        state["moves"] += 1
        state["claims"][row[book]] = (row[job], row[gone])
        return "moved"

    return in_order(requests, user, order, lambda: {"claims": {}, "at": None, "moves": 0}, step, "decision", "string")


def rate_limited(requests: DataFrame, subject: str, seconds: str, order: list[str], limit: int, window: int) -> DataFrame:
    """`bucket` (start of the fixed window) and `allowed`: the first `limit` requests in it."""
    bucket = F.col(seconds) - F.pmod(F.col(seconds), F.lit(window))
    d = requests.withColumn("bucket", bucket)
    return d.withColumn("allowed", F.row_number().over(Window.partitionBy(subject, "bucket").orderBy(*order)) <= limit)


def balances(purchases: DataFrame, reservations: DataFrame) -> DataFrame:
    """user, purchased, reserved, spent, balance from (user, credits) and (user, credits, status)."""
    zero = F.lit(0).cast("long")
    held = [F.when(F.col("status") == s, F.col("credits")).otherwise(zero) for s in ("reserved", "finalized")]
    rows = purchases.select("user", F.col("credits").alias("purchased"), zero.alias("reserved"), zero.alias("spent"))
    rows = rows.unionByName(reservations.select("user", zero.alias("purchased"), held[0].alias("reserved"), held[1].alias("spent")))
    sums = rows.groupBy("user").agg(*(F.sum(c).alias(c) for c in ("purchased", "reserved", "spent")))
    return sums.withColumn("balance", F.col("purchased") - F.col("reserved") - F.col("spent"))


def deltas(reservations: DataFrame) -> DataFrame:
    """The same reserved and spent as signed changes: a reservation first holds its credits, then
    a settlement releases or spends them."""
    c, s = F.col("credits"), F.col("status")
    zero = F.lit(0).cast("long")
    opened = F.struct(c.alias("reserved"), zero.alias("spent"))
    settled = F.when(s == "finalized", F.struct((-c).alias("reserved"), c.alias("spent"))).when(s == "refunded", F.struct((-c).alias("reserved"), zero.alias("spent")))
    moves = reservations.select("user", F.explode(F.array_compact(F.array(opened, settled))).alias("m"))
    return moves.groupBy("user").agg(F.sum("m.reserved").alias("reserved"), F.sum("m.spent").alias("spent"))


def used_cents() -> Column:
    """What a budget reservation counts: actual cents once final, reserved ones before, else none."""
    return F.when(F.col("status") == "finalized", F.col("actual")).when(F.col("status") == "reserved", F.col("cents")).otherwise(0).cast("long")


def budget_rollup(reservations: DataFrame, month: str = "month", day: str = "day") -> DataFrame:
    """Usage by day, by month and in all (nulls mark the coarser rows)."""
    return reservations.rollup(month, day).agg(F.sum(used_cents()).alias("used_cents"), F.count("*").alias("n"))


def classify_purchases(purchases: DataFrame, transaction: str, same: list[str], order: list[str]) -> DataFrame:
    """`outcome`: applied (first of its transaction), replay (equal to the first), conflict.

    The first is found by a two-phase minimum, so a hot transaction is no hot task.
    """
    at = F.struct(*order)
    first = purchases.groupBy(F.col(transaction).alias("__tx")).agg(F.min_by(F.struct(*same), at).alias("__same"), F.min(at).alias("__at"))
    joined = purchases.join(first, F.col(transaction) == F.col("__tx"))
    outcome = F.when(at == F.col("__at"), "applied").when(F.struct(*same) == F.col("__same"), "replay").otherwise("conflict")
    return joined.withColumn("outcome", outcome).drop("__tx", "__same", "__at")


def rejection(expected: dict[str, Column]) -> Column:
    """The first reason why a verified transaction may not be spent, null when it may."""
    return (
        F.when(expected["production"] & (F.col("environment") != "Production"), "environment")
        .when(F.col("bundle") != expected["bundle"], "bundle")
        .when(F.col("type") != "Consumable", "type")
        .when(F.col("revoked"), "revoked")
        .when(~F.col("account").eqNullSafe(expected["account"]), "account")
        .when(F.col("product") != expected["product"], "tier")
    )


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing and the first incoming row of every key that it lacks."""
    at = F.struct(*order)
    rest = [c for c in existing.columns if c not in keys]
    fresh = incoming.join(existing.select(*keys), keys, "left_anti").groupBy(*keys).agg(*(F.min_by(c, at).alias(c) for c in rest))
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, value: str, may: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, value): incoming rows are added, or replace where may(old, new) holds."""
    old, new = existing.select(key, F.col(value).alias("__old")), incoming.select(key, F.col(value).alias("__new"))
    merged = old.join(new, key, "full")
    replaced = F.when(F.col("__old").isNull() | F.coalesce(may(F.col("__old"), F.col("__new")), F.lit(False)), F.coalesce("__new", "__old")).otherwise(F.col("__old"))
    return merged.select(key, replaced.alias(value))


#: What each state may become (a fixed decision table).
TRANSITIONS = {"pending": ["queued", "cancelled"], "queued": ["starting", "error", "cancelled"], "starting": ["running", "error", "cancelled"], "running": ["done", "error", "cancelled"], "error": ["queued", "cancelled"], "cancelled": ["queued"], "done": []}


def legal_transition(before: Column, after: Column) -> Column:
    out = before.isNull() & (after == "pending")
    for state, following in TRANSITIONS.items():
        if following:
            out = out | ((before == state) & after.isin(following))
    return F.coalesce(out, F.lit(False))


def age(seconds: Column) -> Column:
    """Age as a label: now, seconds, minutes, hours, days."""
    n = lambda by, unit: F.concat(F.floor(seconds / by).cast("string"), F.lit(unit))
    return F.when(seconds < 10, "now").when(seconds < 60, n(1, "s")).when(seconds < 3600, n(60, "m")).when(seconds < 86400, n(3600, "h")).otherwise(n(86400, "d"))


def valid_acceptance(now: Column, honoured: list[str]) -> Column:
    """Whether an acceptance (id, locale, method, statement, t) of a release in force since `since` counts."""
    latest = now + F.make_dt_interval(secs=F.lit(fixed.MAX_CLOCK_SKEW_SECONDS))
    known = T.is_named(F.col("id"), fixed.UUID) & T.is_named(F.col("locale"), fixed.LOCALE)
    named = (F.col("method") == "ios-clickwrap") & F.col("statement").isin(honoured)
    return F.coalesce(known & named & (F.col("t") >= F.col("since")) & (F.col("t") <= latest), F.lit(False))
