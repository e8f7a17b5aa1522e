import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import suffix_dedup as sd

SMALL = sd.Repeat(length=20, seed=6, piece=500, part_rows=40)


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def corpus(seed, alphabet, n):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    pool = [piece(rng.choice([10, 19, 20, 21, 40, 90])) for _ in range(12)]
    texts = []
    for _ in range(n):
        texts.append("".join(rng.choice([piece(rng.randrange(30)), rng.choice(pool)]) for _ in range(rng.randrange(7))))
    near = list(piece(300))
    for _ in range(70):
        copy = list(near)
        copy[rng.randrange(300)] = "#"
        texts.append("".join(copy))
    return texts + [None, "", "ab" * 200, "z" * 1500, texts[0] + "é", texts[1], texts[1], pool[5] * 2]


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefgh é"), (2, "ab")])
def test_equals_brute_force(spark, seed, alphabet):
    texts = corpus(seed, alphabet, 60)
    want = brute(texts, SMALL.length)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(5)
    for r in sd.remove_repeats(df, rule=SMALL).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id
    for r in sd.digests(df, rule=SMALL).collect():
        assert (r.n_removed, r.kept_sha256) == (want[r.doc_id][1], hashlib.sha256(want[r.doc_id][3]).hexdigest())


def test_repeated_rows_and_production_length(spark):
    rng = random.Random(9)
    word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = word(80)
    texts = [word(100) + " " + passage + " " + word(50), word(10) + passage, word(300), "short"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    got = sd.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([*texts, texts[2]], 400)
    assert len(got) == 5
    for r in got:
        assert (r.n_removed, r.n_spans) == want[r.doc_id][1:3]


def brute_passages(texts, k):
    """Maximal runs of words covered by windows of k words that another row has too."""
    words = [(t or "").split() for t in texts]
    rows = {}
    for i, w in enumerate(words):
        for j in range(len(w) - k + 1):
            rows.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for w in words:
        gone = bytearray(len(w))
        for j in range(len(w) - k + 1):
            if len(rows[tuple(w[j : j + k])]) > 1:
                gone[j : j + k] = b"\1" * k
        out.append(sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1])))
    return out


@pytest.mark.parametrize("rule", [sd.Repeat(length=20, seed=6, piece=100, passage_words=7, passage_seed=3), sd.Repeat()])
def test_passages_equal_brute_force(spark, rule):
    rng = random.Random(4)
    word = lambda: rng.choice("ab" if rng.random() < 0.2 else "cdefghijkl") * rng.randrange(1, 4)
    k = rule.passage_words
    pool = [" ".join(word() for _ in range(n)) for n in (k - 1, k, k + 1, 3 * k)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.3 else " ".join(word() for _ in range(rng.randrange(3 * k))) for _ in range(rng.randrange(5))]
        texts.append(rng.choice([" ", "\n\t", "  "]).join(parts))
    texts += [None, "", " ", texts[0], texts[0], "a " * 4 * k, pool[1], pool[0], pool[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spots string").repartition(4)
    got = {r.doc_id: r.n_passages for r in sd.digests(docs, rule=rule).collect()}
    want = brute_passages(texts, k)
    assert sum(want) > 20 and [got[i] for i in range(len(texts))] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=6))
def test_merge_of_front_coded_runs(lists):
    runs = [sd.front_coded([(s, len(s), i, j) for j, s in enumerate(sorted(x))]) for i, x in enumerate(lists)]
    out = list(sd.merged(runs)) if runs else []
    assert [s for s, _, _ in out] == sorted(s for x in lists for s in x)
    for (a, _, _), (b, n, _) in zip(out, out[1:]):
        assert n == sd.common(a, b)


def test_both_reach_methods_agree():
    rng = random.Random(3)
    rule = sd.Repeat(length=20, seed=6)
    for _ in range(60):
        rows = sorted({("seedse" + "".join(rng.choice("ab") for _ in range(rng.randrange(6, 15))), "".join(rng.choice("ab") for _ in range(rng.randrange(15)))) for _ in range(30)})
        rows = [(a.encode(), b.encode()) for a, b in rows]
        shared = [0] + [sd.common(a[0], b[0]) for a, b in zip(rows, rows[1:])]
        args = ([len(a) for a, _ in rows], shared, [b for _, b in rows], rule)
        assert tuple(map(list, sd._reach_pairs(*args))) == tuple(map(list, sd._reach_offsets(*args)))


@pytest.mark.parametrize("length,seed", [(20, 6), (21, 6), (9, 4)])
def test_split_seeds_miss_nothing(spark, length, seed):
    """Every seed that occurs twice is split, among texts that share windows to one side of it only."""
    rule = sd.Repeat(length=length, seed=seed, piece=500, part_rows=5, wide_seed=2)
    rng = random.Random(length)
    hot = "q" * seed
    sides = ["".join(rng.choice("ab") for _ in range(length)) for _ in range(4)]
    texts = corpus(3, "ab", 25)
    for i in range(40):
        left, right = rng.choice(sides), rng.choice(sides)
        cut = rng.randrange(length)
        texts.append("".join(rng.choice("cd") for _ in range(rng.randrange(9))) + left[cut:] + hot + right[: rng.randrange(length)] + rng.choice("efgh"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(docs, rule=rule).collect()}
    whole = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeats(docs, rule=sd.Repeat(length=length, seed=seed, piece=500, part_rows=5)).collect()}
    want = brute(texts, length)
    assert got == whole == {i: want[i][1:] for i in got} and any(w[1] for w in want)


def test_empty_table(spark):
    assert sd.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
