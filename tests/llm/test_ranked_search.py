import math
import random
import re
from collections import Counter

import numpy as np

from foliant.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    n_docs, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in bags:
            m = 10 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string").repartition(4)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return rs.search(d, q, **more)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    topics = [[f"t{b}w{i}" for i in range(30)] for b in range(6)]
    docs = []
    for i in range(n):
        own = topics[i % 6]
        docs.append((i, " ".join(rng.choice(own if rng.random() < 0.8 else rng.choice(topics)) for _ in range(rng.randrange(3, 60)))))
    return docs, [(q, " ".join(rng.choice(topics[q % 6]) for _ in range(5))) for q in range(12)]


def test_equals_brute_force_and_skips_shards(spark):
    docs, items = corpus()
    got = found(spark, docs, items, shard_docs=16, first_visits=1)
    assert rows(got) == brute(docs, items)
    shards = {r.item_id: r.shards for r in got.collect()}
    assert all(n < 25 for n in shards.values()) and max(shards.values()) > 1


def test_shards_without_broadcast_and_blocks_of_terms(spark):
    docs, items = corpus(4, 120)
    assert rows(found(spark, docs, items, shard_docs=8, max_broadcast=0)) == brute(docs, items)
    assert rows(found(spark, docs, items, shard_docs=64, block_terms=12)) == brute(docs, items)


def test_copies_ties_nulls_and_odd_texts(spark):
    docs = [(i, "Alpha beta") for i in range(40)] + [(100, None), (101, ""), (102, "?!"), (103, "alpha\x00BETA_beta Été KKİ"), (None, "Alpha beta"), (50, "alpha beta"), (50, "alpha beta")]
    docs += [(200, "beta " * 30_000 + "gamma")]
    items = [(1, "ALPHA!"), (1, "gamma beta"), (2, None), (3, "nowhere"), (4, "été Été"), (None, "alpha alpha"), (6, "K kKİ")]
    assert rows(found(spark, docs, items)) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]).collect() == []
    assert found(spark, [(1, "a")], []).collect() == []
    assert found(spark, [(1, None)], [(1, "a")]).collect() == []


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 1500)])) for _ in range(40))
        assert [t.decode() for t in rs.terms_of(text.encode())] == terms(text)


def gaps_cost(order, doc, term, n_terms):
    """Bits of the gaps of all posting lists under an order of documents."""
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    cost = 0.0
    for t in range(n_terms):
        at = np.sort(place[doc[term == t]])
        cost += np.log2(np.diff(np.concatenate([[-1], at]))).sum() if len(at) else 0
    return cost


def test_bisection_shortens_gaps_and_the_tree_places_documents():
    rng = np.random.default_rng(7)
    n, per = 256, 12
    topic = rng.permutation(np.arange(n) % 4)
    doc = np.repeat(np.arange(n), per)
    term = (topic[doc] * 40 + rng.integers(0, 40, n * per)).astype(int)
    doc, term = np.unique(np.stack([doc, term]), axis=1)
    weights = rs.bisection(doc, term, n, 160, rs.Sample(depth=3))
    leaf = np.array([rs.leaf_of(term[doc == d], weights, 3) for d in range(n)])
    assert gaps_cost(np.argsort(leaf, kind="stable"), doc, term, 160) < 0.8 * gaps_cost(np.arange(n), doc, term, 160)
    own = sum(np.bincount(topic[leaf == x], minlength=4).max() for x in set(leaf))
    assert own > 0.9 * n  # a leaf holds documents of one topic
    fresh = np.array([t * 40 + i for t in (2,) for i in range(12)])
    assert np.bincount(topic[leaf == rs.leaf_of(fresh, weights, 3)], minlength=4).argmax() == 2
