import math
import random
from itertools import combinations

import pytest

from foliant.llm import decontamination as dc
from foliant.llm import queries


def brute(doc, item):
    """Whether the item lies over the document without gaps with enough equal tokens."""
    d, q = dc.tokens(doc), dc.tokens(item)
    need = min(13, len(q))
    if len(q) < 5:
        return bool(q) and d == q
    for start in range(need - len(q), len(d) - need + 1):
        same = [0 <= start + j < len(d) and d[start + j] == w for j, w in enumerate(q)]
        for a in range(len(q) - need + 1):
            if start + a >= 0 and start + a + need <= len(d) and sum(same[a : a + need]) >= 0.8 * need:
                return True
    return False


def world(rng):
    word = lambda: f"w{rng.randrange(4000)}"
    items = [" ".join(word() for _ in range(n)) for n in (20, 30, 16, 13, 12, 11, 10, 9, 8, 7, 6, 5, 40, 60)]
    docs = []
    for i in range(200):
        text = [word() for _ in range(rng.choice([0, 5, 60, 400]))]
        if i % 4 == 0:
            q = dc.tokens(rng.choice(items))
            for _ in range(0 if i % 8 else len(q) // 5):
                q[rng.randrange(len(q))] = "Changed!"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [q[0].upper() + ","] + q[1:]
        docs.append(" ".join(text))
    return items, docs + [None, "", docs[0]]


JOINED = dc.Overlap(index_bytes=0, filter_bits=14, lot=3)


@pytest.mark.parametrize("rule", [dc.Overlap(), JOINED, dc.Overlap(index_bytes=0)])
def test_both_ways_equal_brute_force(spark, rule):
    items, docs = world(random.Random(4))
    items, docs = items + [None, "", "!?", "too short"], docs + ["Too, short.", "this is too short"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.overlaps(df, bench, rule=rule).collect()}
    want = {(i, k) for i, t in enumerate(docs) for k, q in enumerate(items) if brute(t, q)}
    assert got == want and len(want) > 40
    kept = dc.clean(df, bench, rule=rule)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in got}


@pytest.mark.parametrize("n", [*range(5, 14), 14, 20])
def test_every_placement_of_the_allowed_substitutions_is_found(n):
    """All ways to change a fifth of an item, and of every 13 tokens of a longer one."""
    item = [f"w{i}" for i in range(n)]
    index, hasher = dc.Index([(1, " ".join(item))]), dc.Hasher()
    need = min(n, 13)
    for first in range(n - need + 1):
        for gone in combinations(range(need), need - math.ceil(0.8 * need)):
            # all tokens outside the stretch differ as well
            text = [w if first <= i < first + need and i - first not in gone else f"x{i}" for i, w in enumerate(item)]
            assert 1 in index.overlaps(hasher(["a", "b", *text, "c"])), (first, gone)


def test_query_finds_planted_items(spark, tmp_path):
    items, docs = world(random.Random(9))
    docs = [t for t in docs if t is not None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, str(tmp_path)).collect()}
    assert got == {(i, k) for i, t in enumerate(docs) for k, q in enumerate(items) if brute(t, q)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert dc.overlaps(docs, bench).count() == 0 and dc.clean(one, bench).count() == 1
    item = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.overlaps(docs, item, rule=JOINED).count() == 0 and dc.clean(one, item, rule=JOINED).count() == 0


def test_both_ways_tell_the_same_overlaps(spark):
    """Starts and lengths too, where hits lie at many offsets, texts repeat, and ids are null or repeat."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(2)}"
    items = [(k % 30 or None, " ".join(word() for _ in range(rng.choice([1, 3, 5, 8, 13, 30])))) for k in range(40)] + [(7, None), (8, "")]
    docs = [(i % 50 or None, " ".join(word() for _ in range(rng.choice([0, 3, 20, 300]))), 1) for i in range(60)] + [(1, items[5][1], 2)] * 3 + [(2, None, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, digest int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, other = (sorted(map(tuple, dc.overlaps(df, bench, rule=r).collect()), key=repr) for r in (dc.Overlap(), JOINED))
    assert one == other and len(one) > 300
    kept = [sorted(map(tuple, dc.clean(df, bench, rule=r).collect()), key=repr) for r in (dc.Overlap(), JOINED)]
    assert kept[0] == kept[1] and (2, None, 3) in kept[0]
