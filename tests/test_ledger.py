"""Order-dependent ledgers against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.operators import ledger


def test_budget(spark):
    rng = random.Random(3)
    rows = [(i, f"2024-0{1 + d // 5}", f"2024-0{1 + d // 5}-1{d % 5}", rng.randint(1, 60)) for i, d in enumerate(sorted(rng.randrange(10) for _ in range(200)))]
    got = {r.id: r.admitted for r in ledger.admit_budget(spark.createDataFrame(rows, "id long, month string, day string, cents long"), "month", "day", ["id"], "cents", 300, 900).collect()}
    used, want = {}, {}
    for i, m, d, c in rows:
        want[i] = used.get(d, 0) + c <= 300 and used.get(m, 0) + c <= 900
        if want[i]:
            used[d], used[m] = used.get(d, 0) + c, used.get(m, 0) + c
    assert got == want and len(set(got.values())) == 2


def test_claims(spark):
    week = 604800
    rows = [  # id, user, book, job, at, gone
        (1, 1, 1, 10, 0, True), (2, 1, 1, 10, 1, True), (3, 1, 1, 11, 2, True), (4, 1, 1, 12, 3, True), (5, 1, 1, 13, 4, True),
        (6, 1, 1, 14, 5, True), (7, 1, 2, 20, 6, False), (8, 1, 2, 21, 7, True), (9, 1, 1, 15, week, False), (10, 1, 1, 16, week + 1, True),
    ]
    d = spark.createDataFrame(rows, "id long, user long, book long, job long, at long, gone boolean")
    got = [r.decision for r in ledger.claim_previews(d, "user", "book", "job", ["id"], "at", "gone").orderBy("id").collect()]
    assert got == ["claimed", "same", "moved", "moved", "moved", "limited", "claimed", "held", "moved", "held"]


def test_credits(spark):
    d = spark.createDataFrame([(1, 1, 250, None), (2, 1, 0, 120), (3, 1, 0, 131), (4, 1, 0, 130), (5, 2, 0, 1)], "id long, user long, g long, w long")
    got = [r.reserved for r in ledger.reserve_credits(d, "user", ["id"], "g", "w").orderBy("id").collect()]
    assert got == [None, True, False, True, False]
    bought = spark.createDataFrame([(1, 250)], "user long, credits long")
    held = spark.createDataFrame([(1, 120, "finalized"), (1, 30, "reserved"), (1, 9, "refunded")], "user long, credits long, status string")
    assert [tuple(r) for r in ledger.balances(bought, held).collect()] == [(1, 250, 30, 120, 100)]
    assert [tuple(r) for r in ledger.deltas(held).collect()] == [(1, 30, 120)]


def budget_by_the_book(moves, day_cap, month_cap):
    used, jobs, out = Counter(), {}, []
    for _, day, kind, job, cents in moves:
        held = jobs.get(job)
        if kind == "ask":
            if held:
                out.append("held" if held[1] == cents else "refused")
            elif used[day] + cents > day_cap or used[day[:7]] + cents > month_cap:
                out.append("refused")
            else:
                used[day] += cents
                used[day[:7]] += cents
                jobs[job] = [day, cents, True]
                out.append("acquired")
        elif not held or not held[2]:
            out.append("ignored")
        else:
            change = -held[1] if kind == "refund" else cents - held[1]
            used[held[0]] += change
            used[held[0][:7]] += change
            out.append("refunded" if kind == "refund" else "finalized")
            if kind == "refund":
                del jobs[job]
            else:
                held[2] = False
    return out


BUDGET_MOVE = "id long, day string, kind string, job string, cents long"


def decisions(df):
    return [r.decision for r in df.orderBy("id").collect()]


def test_a_job_is_one_job_in_all_months(spark):
    moves = [(1, "2024-01-05", "ask", "a", 60), (2, "2024-02-01", "refund", "a", 0), (3, "2024-02-01", "ask", "a", 60), (4, "2024-01-06", "ask", "b", 100), (5, "2024-03-01", "ask", "a", 60)]
    got = decisions(ledger.budget_moves(spark.createDataFrame(moves, BUDGET_MOVE), ["id"], 100, 100))
    assert got == ["acquired", "refunded", "acquired", "acquired", "held"] == budget_by_the_book(moves, 100, 100)


@pytest.mark.parametrize("months", [1, 3])
def test_a_hot_month_over_many_ranges_equals_one_sequence(spark, months):
    rng = random.Random(months)
    moves = [(i, f"2024-0{rng.randint(1, months)}-{rng.randint(1, 4):02d}", rng.choice(["ask", "ask", "ask", "finalize", "refund"]), f"j{rng.randrange(40)}", rng.choice([5, 9, 14])) for i in range(300)]
    rows = spark.createDataFrame(random.Random(1).sample(moves, 300), BUDGET_MOVE)
    want = budget_by_the_book(moves, 60, 150)
    assert len(set(want)) == 6
    assert decisions(ledger.budget_moves(rows, ["id"], 60, 150, range_rows=60)) == want
    assert decisions(ledger.budget_moves(rows, ["id"], 60, 150)) == want


CREDIT_MOVE = "id long, user string, kind string, job string, quote string, credits long"


def credits_by_the_book(moves):
    left, jobs, out = Counter(), {}, []
    for _, user, kind, job, quote, credits in moves:
        held = jobs.get(job)
        if kind == "grant":
            left[user] += credits
            out.append("granted")
        elif kind == "reserve":
            if held and held[:3] != [user, quote, credits]:
                out.append("mismatched")
            elif held and held[3] != "refund":
                out.append("repeated")
            elif credits > left[user]:
                out.append("short")
            else:
                left[user] -= credits
                jobs[job] = [user, quote, credits, "reserve"]
                out.append("reserved")
        elif not held or held[3] != "reserve":
            out.append("ignored")
        else:
            held[3] = kind
            left[held[0]] += held[2] if kind == "refund" else 0
            out.append("refunded" if kind == "refund" else "finalized")
    return out


def test_a_job_has_one_holder(spark):
    moves = [(1, "u", "grant", None, None, 100), (2, "v", "reserve", "a", "q", 60), (3, "v", "grant", None, None, 100), (4, "u", "reserve", "a", "q", 60), (5, "v", "reserve", "a", "q", 60), (6, "v", "refund", "a", None, 0), (7, "v", "reserve", "a", "q", 60), (8, "u", "reserve", "b", "q", 100)]
    got = decisions(ledger.credit_moves(spark.createDataFrame(moves, CREDIT_MOVE), ["id"]))
    assert got == ["granted", "short", "granted", "reserved", "mismatched", "refunded", "mismatched", "reserved"]  # u holds it, its refund is u's


def test_credit_moves_over_many_ranges(spark):
    rng = random.Random(8)
    moves = []
    for i in range(400):
        kind, job = rng.choice(["grant", "reserve", "reserve", "reserve", "finalize", "refund"]), f"j{rng.randrange(30)}"
        moves.append((i, f"u{rng.randrange(6)}", kind, None if kind == "grant" else job, rng.choice(["q", "q", "r"]), 50 if kind == "grant" else 20))
    want = credits_by_the_book(moves)
    assert len(set(want)) == 8
    got = ledger.credit_moves(spark.createDataFrame(moves, CREDIT_MOVE), ["id"], range_rows=70)
    assert decisions(got) == want and set(got.columns) == {"id", "user", "kind", "job", "quote", "credits", "decision"}


def test_no_moves(spark):
    assert ledger.budget_moves(spark.createDataFrame([], BUDGET_MOVE), ["id"]).collect() == []


def test_empty(spark):
    d = spark.createDataFrame([], "id long, user long, g long, w long")
    assert ledger.reserve_credits(d, "user", ["id"], "g", "w").collect() == []


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 5)], "k string, v long")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "k string, v long")
    assert sorted(map(tuple, ledger.upsert(old, new, "k", "v", lambda o, n: n > o).collect())) == [("a", 2), ("b", 5), ("c", 4)]
    assert sorted(map(tuple, ledger.insert_or_ignore(old, new.withColumn("at", F.lit(1)), ["k"], ["at"]).collect())) == [("a", 1), ("b", 5), ("c", 4)]


@pytest.mark.parametrize("before,after,legal", [(None, "pending", True), ("queued", "starting", True), ("done", "queued", False), ("cancelled", "queued", True), ("pending", "done", False)])
def test_transitions(spark, before, after, legal):
    d = spark.createDataFrame([(before, after)], "b string, a string")
    assert d.select(ledger.legal_transition(F.col("b"), F.col("a"))).first()[0] is legal
