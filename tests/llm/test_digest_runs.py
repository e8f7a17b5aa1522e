import hashlib
import random

import numpy as np
import pytest

from foliant.llm import digest_runs as runs


def brute(rows, keep):
    """doc_id -> (keep_id, group_size), and how many rows of each text stay: one."""
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    pick = max if keep == "largest" else min
    out = []
    for t, ids in by_text.items():
        known = [i for i in ids if i is not None]
        out += [(i, pick(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(spark, rows, keep, **more):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, keep_id string, digest int")
    got = runs.exact_dedup(docs.repartition(5), keep=keep, **more).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows, keep)
    stays = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert len(stays) == len({s for s, _ in stays}) == len({t or "" for _, t in rows})  # one row of each text
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_of_every_kind(spark, keep):
    rng = random.Random(5)
    rows = [(i, f"text {rng.randrange(60)}") for i in range(300)] + [(1000 + i, "hot") for i in range(200)]
    rows += [(2000, None), (2001, ""), (2002, "é" * 100_000), (2003, "é" * 100_000), (2004, "é"), (2005, "é")]
    rows += [(3000, "again")] * 3 + [(None, "nobody"), (None, "nobody"), (None, "text 1"), (None, None)]
    check(spark, rows, keep)


def test_many_rounds_and_shuffled_groups(spark):
    """Runs of four rows need four rounds; groups that may not be broadcast are joined."""
    rng = random.Random(6)
    rows = [(i, f"t{rng.randrange(200)}" if i % 3 else "hot") for i in range(900)]
    check(spark, rows, "largest", run_rows=4, max_broadcast=0)


def test_empty_table_and_normalised_texts(spark):
    from pyspark.sql import functions as F

    assert runs.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in runs.exact_dedup(docs, normalise=lambda t: F.lower(F.regexp_replace(t, " +", " "))).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_short_digests_that_agree_are_told_apart():
    words = np.array([[1, 2, 3, 5], [1, 2, 3, 4], [1, 2, 3, 5], [0, 9, 9, 9]], np.uint64)
    made = (words, np.array([7, 8, 5, 1]), np.ones(4, bool), np.arange(4), np.ones(4, np.int64))
    out = runs.merged([made], largest=False)
    assert out[0].tolist() == [[0, 9, 9, 9], [1, 2, 3, 4], [1, 2, 3, 5]]
    assert out[1].tolist() == [1, 8, 5] and out[3].tolist() == [3, 1, 2] and out[4].tolist() == [1, 1, 2]


def test_pieces_of_a_run_go_where_their_digit_says():
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(0, 2**60, (500, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(5 << 61), axis=0)  # after one round all begin alike
    made = (words, np.arange(500), np.ones(500, bool), np.arange(500), np.ones(500, np.int64))
    batch = runs._pieces(made, 5 + 8 * 3, 1)
    assert sorted(batch.column("slot").to_pylist()) == [5 + 8 * d for d in range(8)]
    for slot, raw in zip(batch.column("slot").to_pylist(), batch.column("digests").to_pylist()):
        top = np.frombuffer(raw, np.uint64).reshape(-1, 4)[:, 0]
        assert ((top >> np.uint64(58)) & np.uint64(7) == slot // 8).all()
