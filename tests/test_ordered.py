"""Ordered scans and term automata against plain Python."""

import random

from foliant.operators import glossary, ordered_scan


def test_scan_of_hot_and_null_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None, "b"]), i, rng.choice([None, 1, 5])) for i in range(300)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, at long, v long")
    got = {r.at: (r.before_v, r.last_v) for r in ordered_scan.scan(d, "k", ["at"], sums=["v"], last=["v"], parts=7).collect()}
    total, last, want = {}, {}, {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        want[at] = (total.get(k, 0), last.get(k))
        total[k], last[k] = total.get(k, 0) + (v or 0), v
    assert got == want


def test_scan_of_nothing(spark):
    assert ordered_scan.scan(spark.createDataFrame([], "k string, at long, v long"), "k", ["at"], sums=["v"], last=["v"]).collect() == []


def test_terms_in_blocks_equal_containment(spark):
    rng = random.Random(5)
    words = ["an", "ana", "banana", "nan", "Bern", "Berne", "x", "Klára"]
    pairs = [(i, " ".join(rng.choice(words) for _ in range(6)) if i % 9 else None, rng.choice(["ana BERNÉ", "kláráé", "", None, "x nan"])) for i in range(60)]
    terms = [(w, w) for w in words] + [("ana", "other"), ("", "empty"), ("void", "")]

    def lacks(t, r):
        t, r = (t or "").lower(), r.lower()
        longer = r[:-1] + {"a": "á", "e": "é"}.get(r[-1], r[-1])
        return r not in t and longer not in t

    want = {(k, w) for k, s, t in pairs if s for w, r in terms if w and r and w in s and lacks(t, r)}
    d, g = spark.createDataFrame(pairs, "k long, s string, t string"), spark.createDataFrame(terms, "term string, rendering string")
    for block in (1, 1 << 20):
        missing = glossary.missing_terms(d, g, "k", "s", "t", block_bytes=block)
        rows = [tuple(r) for r in missing.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    plan = missing._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange") :].split("\n")[0]
    assert "term" in exchange and "target" not in exchange and "s#" not in exchange
    assert glossary.missing_terms(d, g.limit(0), "k", "s", "t").collect() == []
