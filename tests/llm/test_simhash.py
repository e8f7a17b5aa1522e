import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import simhash
from foliant.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w)] if 0 < len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2 and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()][:600]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "Two Words"), (5004, "two words"), (5005, "É x y z"), (5006, rows[5][1] + " and")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]], "doc_id long, text string, fp string")
    got = simhash.fingerprint_components(docs).select("doc_id", simhash.hexed(F.col("fp")).alias("f"), "component_id").collect()
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    assert len(got) == len(rows) + 3
    for r in got:
        assert (r.f, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("crowd", [64, 3, 1])
def test_links_at_two_bits_in_any_segments(spark, crowd):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    fps = {base} | {base ^ 1 << rng.randrange(63) for _ in range(20)} | {base ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for _ in range(50)}
    fps |= {rng.getrandbits(63) for _ in range(200)} | {base ^ 7 << 40}
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd)
    roots = {r.node: r.root for r in components(links).collect()}
    want = brute_components(dict(zip(sorted(fps), sorted(fps))))
    assert {f: roots.get(f, f) for f in fps} == want


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components_of_chains(spark, n):
    rng = random.Random(n)
    links = [(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(n)] + [(100, 101), (101, 101)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1) if n}, 100: 100, 101: 100}


def near_copy(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [64, 2])
def test_one_document_of_each_group_stays(spark, crowd):
    rng = random.Random(1)
    texts, groups = [], []
    for g in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for c in range(1 if g < 4 else 6):
            texts.append(near_copy(rng, words, 0 if c < 2 else 3))
            groups.append(g)
    rows = [(100 + i, t, "x") for i, t in enumerate(texts)] + [(1, None, "x"), (2, "", "x"), (100, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = simhash.near_duplicates(docs, crowd=crowd)
    assert kept.columns == docs.columns
    first = {}
    for i, g in enumerate(groups):
        first.setdefault(g, 100 + i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([1, *first.values()])


def jaccard(x, y, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (x, y))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("crowd", [64, 2])
def test_groups_equal_all_pairs(spark, crowd):
    """Near copies of few texts around the limit, so that entries mix what is similar and what is not."""
    rng = random.Random(12)
    texts = []
    for g in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        texts += [near_copy(rng, words, rng.randrange(0, 7)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in simhash.duplicate_groups(docs, crowd=crowd).collect():
        got.setdefault(r.group, set()).add(r.doc_id)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    want = {}
    for i in range(len(texts)):
        want.setdefault(top(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pairs_near_the_limit_are_decided_by_shingle_sets(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    for g in range(160):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        if g % 2:  # differences that lie together
            other = words[: 120 - rng.randrange(12, 40)]
        else:
            other = near_copy(rng, words, rng.randrange(1, 6)).split()
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        pairs.append(jaccard(*(t for _, t in rows[-2:])) >= 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_duplicates(docs).collect()}
    assert [2 * g + 1 not in kept for g in range(160)] == pairs and 40 < sum(pairs) < 120


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 == simhash.fingerprint_components(docs).count()
