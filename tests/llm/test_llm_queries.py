"""The registered queries of the corpus operators against their SQL twins, on the smallest tables."""

import glob
import itertools
import os
import re
from collections import Counter

import duckdb
import pytest

from foliant.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    twin = con.execute(oracles.ORACLE_SQL[name])
    names = [c[0] for c in twin.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r))[c] for c in columns) for r in twin.fetchall()), key=repr)
    assert want and sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want


# ---- registered queries that SQL can't say, against plain Python -----------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


def test_op1_equals_the_tokenizer(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, SF).collect()}
    for doc, text, _ in docs:
        n = len(known.encode(text or "", add_special_tokens=False).ids)
        assert got[doc] == (len((text or "").encode()), n, n > 512)


def test_op2_equals_all_pairs(spark, docs):
    import xxhash

    prints = {}
    for doc, text, _ in docs:
        w = WORD.findall((text or "").translate(LOWER))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_op8_sizes_targets_and_words_taken(spark, docs):
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    total = Counter()
    for d, _, s in docs:
        total[s] += size[d]
    weights = dict(zip(sorted(total, key=lambda s: (s is None, s or "")), itertools.cycle([5, 2, 1])))
    left, open_, target = 1.5 * sum(total.values()), set(total), {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if share * weights[s] > 2 * total[s]}
        if not over:
            target |= {s: share * weights[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    source = {d: s for d, _, s in docs}
    rows = queries.op8_mixing(spark, SF).collect()
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    longest = Counter()
    for d in size:
        longest[source[d]] = max(longest[source[d]], size[d])
    assert len(rows) == len(docs) and all(abs(taken[s] - target[s]) <= longest[s] for s in total)
    assert rows == queries.op8_mixing(spark, SF).collect()
