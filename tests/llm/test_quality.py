import re
from collections import Counter

import duckdb

from foliant.llm import oracles, quality

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = SPLIT.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    repeats = len(covered)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats, len(w) < 50 or 100 * repeats > 50 * len(w))


TEXTS = [None, "", "  \t\n", "a b", "a a a a a", "x y z\nx y z\n\n \nx y z q", "#$ é b <|>", "one two three four " * 40, " ".join(f"w{i}" for i in range(80)), "\x0b\x0cword\r\nword"]


def test_measures_equal_brute_force(spark):
    rows = [(i, t, "h", "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "h", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    got = quality.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[m] for m in (*quality.MEASURES, "base_failed")) == brute(TEXTS[r.doc_id])


def test_measures_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs).collect():
        assert tuple(r[m] for m in (*quality.MEASURES, "base_failed")) == brute(texts[r.doc_id])


def test_bad_host_loses_good_documents_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i < 5 else "short", "bad") for i in range(100)]
    rows += [(1000 + i, good, f"h{i % 20}") for i in range(2000)]
    rows += [(5000, "short", "tiny"), (5001, good, None), (5002, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert not kept & set(range(100))
    assert set(range(1000, 3000)) <= kept and 5001 in kept and 5002 not in kept
    spared = {r.doc_id for r in quality.keep(docs, rules=quality.Rules(max_host_rate=2.0)).collect()}  # no rate passes 1
    assert spared == kept | set(range(5))


def test_host_verdicts_equal_sql_where_hosts_are_rejected_and_small_ones_saved(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 25 == 0 else "short", "bad") for i in range(200)] + [(1000 + i, good if i % 10 else "short", f"h{i % 12}") for i in range(900)]
    rows += [(5000 + i, t, s) for i, (t, s) in enumerate([("short", "tiny"), (good, "tiny"), ("short", "alone"), (good, None), (None, None), ("short", "pair"), ("short", "pair"), (good, "pair")])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    twin = con.execute(oracles.QUALITY)
    names = [c[0] for c in twin.description]
    want = sorted(twin.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == want
    lost = [r for r in got if not r[names.index("base_failed")] and not r[names.index("kept")]]
    assert len(lost) == 8 and all(r[0] < 200 for r in lost)  # the good documents of the bad host, and of no other


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, kept int")
    assert quality.keep(docs).columns == docs.columns
    assert quality.keep(docs).count() == 0 == quality.score(docs).count()
