import random
from collections import Counter

import pytest

from foliant.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return target


def table(spark, n, seed=1):
    rng = random.Random(seed)
    names = ["b", "a", "é", "z", None, "c1", "c2"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(names)
        size = rng.choice([0, 1, 5, 30, 300])
        rows.append((i, " ".join(["w"] * size) if size else rng.choice([None, "", " "]), source, "x"))
    rows += rows[:5]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


@pytest.mark.parametrize("bucket_rows", [mixing.BUCKET_ROWS, 10])
def test_targets_are_met_and_reruns_agree(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows, docs = table(spark, 1500)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 300 + 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    sampled = mixing.sample(docs).collect()
    assert sum(len(r.text.split()) * r.copies for r in sampled) == sum(taken.values())
    assert len(sampled) == sum(r.copies > 0 for r in got)


def test_rounding_is_unbiased(spark):
    docs = spark.createDataFrame([(i, "s" if i % 2 else "t", 1 + i % 7) for i in range(60)], "doc_id long, source string, size long")
    n = 12
    mean = {}
    for seed in range(n):
        for r in mixing.copies(docs, seed).collect():
            mean.setdefault((r.source, r.target / r.source_size), []).append(r.copies)
    for (_, rate), c in mean.items():
        assert abs(sum(c) / len(c) - rate) < 0.15


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 == mixing.sample(empty).count()
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(none).collect()] == [0, 0]


def test_sample_of_repeated_rows_and_its_shuffles(spark):
    """Rows of one key take as many copies together as `mix` gives them, and texts are shuffled once."""
    rows = [(None, "a b c " + "d " * (i % 3), None, i) for i in range(300)] + [(i, "e f g h", "s", i) for i in range(100)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    want, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    sampled = mixing.sample(docs)
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    for r in sampled.collect():
        got[r.doc_id, r.source, r.size] += r.copies
        assert r.size == len(r.text.split()) and r.copies in (1, 2)
    assert got == +want and len(got) > 50
    texts = [line for line in plan.splitlines() if "Exchange hashpartitioning(__key" in line]
    assert len(texts) == 1
