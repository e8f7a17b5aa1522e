import math
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import ctw, queries


def brute_next(texts, depth, context):
    """Probability of every next byte by the recursive definition, all contexts kept."""
    seen = [(t2[i - depth : i], t2[i]) for t in texts for t2 in [bytes(depth) + t + b"\0"] for i in range(depth, len(t2))]

    def kt(zeros, ones):
        return sum(math.log(i + 0.5) for i in range(zeros)) + sum(math.log(i + 0.5) for i in range(ones)) - sum(math.log(i + 1) for i in range(zeros + ones))

    @cache
    def node(suffix, prefix):
        """(log own, log weighted, zeros, ones) of a context and the bits decided so far."""
        nexts = [b for c, b in seen if c[depth - len(suffix) :] == suffix and f"{b:08b}".startswith(prefix)]
        ones = sum(f"{b:08b}"[len(prefix)] == "1" for b in nexts)
        own = kt(len(nexts) - ones, ones)
        if len(suffix) == depth:
            return own, own, len(nexts) - ones, ones
        below = sum(node(bytes([x]) + suffix, prefix)[1] for x in {c[depth - len(suffix) - 1] for c, _ in seen if c[depth - len(suffix) :] == suffix})
        return own, np.logaddexp(own, below) - math.log(2), len(nexts) - ones, ones

    out = []
    for byte in range(256):
        p = 1.0
        for i in range(8):
            bits = f"{byte:08b}"
            one = None
            for d in range(depth, -1, -1):
                own, weighted, zeros, ones = node(context[depth - d :], bits[:i])
                mine = (ones + 0.5) / (zeros + ones + 1)
                stop = 1.0 if d == depth else math.exp(own - math.log(2) - weighted)
                one = mine if one is None else stop * mine + (1 - stop) * one
            p *= one if bits[i] == "1" else 1 - one
        out.append(p)
    return out


def tree_values(texts, unseen, depth):
    """Strings and their log10 values, learnt from texts, with places for those of unseen."""
    counted = [ctw.grams(texts, depth)] if texts else []
    keys, n = ctw._summed([*counted, *((k, m * 0) for k, m in [ctw.grams(unseen, depth)])])
    top = ctw._top(depth)
    parts = [ctw._part(keys) == p for p in set(ctw._part(keys).tolist())]
    trees = [ctw.Subtree(keys[i], n[i], depth, top) for i in parts]
    joined = [np.concatenate([getattr(t.levels[0], c) for t in trees]) for c in ("keys", "zeros", "ones", "weighted")]
    order = np.argsort(joined[0])
    first = ctw.Level(*(c[order] for c in joined[:3]), weighted=joined[3][order])
    mixed, left = ctw.reached(first, top)
    out = np.empty(len(keys))
    for i, t in zip(parts, trees):
        at = np.searchsorted(first.keys, t.levels[0].keys)
        out[i] = t.log10(mixed[at], left[at])
    return keys, out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_values_equal_the_recursive_definition(depth):
    texts = [b"abab", b"abc", b"", b"bcacab"]
    asked = [c + bytes([b]) for c in (b"\0\0\0", b"bab", b"\0\0a", b"abc", b"zzz") for b in range(256)]
    unseen = [a[-depth - 1 :] for a in asked]
    keys, log10 = tree_values(texts, unseen, depth)
    for context in {a[-depth - 1 : -1] for a in asked}:
        key = [int.from_bytes(context + bytes([b]), "big") for b in range(256)]
        p = 10.0 ** log10[np.searchsorted(keys, key)]
        assert p == pytest.approx(brute_next(texts, depth, context), rel=1e-9)
        assert p.sum() == pytest.approx(1)


def test_packed_numbers_come_back():
    for x in (np.array([], np.int64), np.array([5]), np.array([3, 9, 1 << 47])):
        assert ctw._unpacked(ctw._packed(x, True), np.int64, True).tolist() == x.tolist()
        assert ctw._unpacked(ctw._packed(x.astype(np.float32)), np.float32).tolist() == x.astype(np.float32).tolist()


def test_units_groups_and_parts_do_not_change_scores(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "there", "other", "then", "x" * 40]) for _ in range(rng.randrange(90)))) for i in range(120)] + [(5, "z" * 30_000), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held = F.col("doc_id") % 3 == 1
    texts = [ctw.tools.lower_bytes(t) for _, t in rows]
    learnt = [t for (i, _), t in zip(rows, texts) if i % 3 != 1]
    keys, log10 = tree_values(learnt, texts, 5)
    want = sorted(zip([i for i, _ in rows], ctw.text_scores(texts, 5, keys, log10).tolist()))
    for tree in (ctw.Tree(unit_bytes=300), ctw.Tree(unit_bytes=300, group_units=3), ctw.Tree(unit_bytes=8_000_000)):
        got = sorted((r.doc_id, r.score) for r in ctw.score(docs, held_out=held, tree=tree).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [v for _, v in got] == pytest.approx([v for _, v in want], rel=1e-5)


def test_nothing_is_copied_for_each_group_of_units(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(60)], "doc_id long, text string").select("doc_id", F.lit(False).alias("held_out"), "text")
    sizes = {}
    for groups in (1, 4, 16):
        told = ctw.survey(docs.coalesce(1), ctw.Tree(unit_bytes=400), 10 + groups.bit_length() - 1)
        known = ctw.values(ctw.totals(told, groups), ctw.Tree())
        found = ctw.asked(told, known, groups)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
        sizes[groups] = found.agg(F.sum(F.length("log10"))).first()[0], known.agg(F.sum(F.length("log10"))).first()[0]
        assert len(ctw._part(np.arange(1 << 20) << 3, 12)) and set(r.part for r in known.collect()) <= set(range(1 << (10 + groups.bit_length() - 1)))
    assert len(set(sizes.values())) == 1


def test_scores_and_baseline(spark):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(900, None, "x"), (901, "", "x"), (902, "Unseen qqqqq zzz", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    tree = ctw.Tree(max_words=50)
    held = lambda i: i % 5 == 2
    got = ctw.score(docs, held_out=F.col("doc_id") % 5 == 2, tree=tree).collect()
    split = lambda t: ctw.tools.lower_bytes(t).split()
    train = [t for i, t, _ in rows if not held(i)]
    c = Counter(w for t in train for w in split(t))
    c["end"] = len(train)
    n, over = sum(c.values()), sum(c.values()) + len(c) + 1
    by = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    bits = {True: [], False: []}
    for r in got:
        w = [*split(by[r.doc_id]), "end"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(r.doc_id))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / over) for x in w))
        if len(w) > 50:
            bits[r.held_out].append(r.bits_per_byte)
    assert np.mean(bits[True]) < 3.6 and np.mean(bits[False]) < 3.6
    alike = ctw.score(docs, held_out=F.col("doc_id") % 5 == 2, tree=ctw.Tree(max_words=1 << 18)).collect()
    assert {(r.doc_id, round(r.base_score, 6), r.n_known) for r in alike} == {(r.doc_id, round(r.base_score, 6), r.n_known) for r in got}


def test_empty_and_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score(none).count() == 0
    r = ctw.score(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), held_out=F.lit(True)).first()
    assert r.bits_per_byte == pytest.approx(8) and r.n_known == 0 and r.train_tokens == 0


def test_registered_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    split = {i: ctw.tools.lower_bytes(t).split() for i, t in rows}
    n_docs = sum(not h for h in held.values())
    c = Counter(w for i, words in split.items() if not held[i] for w in words)
    n, over = sum(c.values()) + n_docs, sum(c.values()) + n_docs + len(c) + 2
    learnt = [ctw.tools.lower_bytes(t) for i, t in rows if not held[i]]
    texts = [ctw.tools.lower_bytes(t) for _, t in rows]
    scores = dict(zip(split, ctw.text_scores(texts, 5, *tree_values(learnt, texts, 5))))
    got = queries.op3_context_tree(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(split)
    for r in got:
        words = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(words) + 1, sum(c[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(math.log10((n_docs + 1) / over) + sum(math.log10((c[w] + 1) / over) for w in words))
        assert r.score == pytest.approx(scores[r.doc_id], rel=1e-5)
