import random
import re

import pytest

from foliant.llm import line_templates as lt


def masked(line):
    return re.sub(r"\S*[0-9]\S*", "<*>", " ".join(re.findall(r"[^\x20\x09-\x0D]+", line)))


def brute(docs, tree):
    """kept text of every document, by the rules in plain Python."""
    lines, leaves = [], {}
    for i, t in enumerate(docs):
        own = [masked(x) for x in (t or "").split("\n") if x.split()]
        for j, x in enumerate(own):
            edge = ("doc", t) if len(own) > 1 else None
            lines.append((x, own[j - 1] if j else edge, own[j + 1] if j + 1 < len(own) else edge))
    lines = [x for x in lines if sum(w != "<*>" for w in x[0].split()) >= tree.min_words]
    for x, _, _ in lines:
        w = x.split()
        if len(w) >= tree.min_generalised:
            leaves.setdefault((len(w), *w[: tree.depth]), []).append(x)
    template = {}
    for leaf, xs in leaves.items():
        if len(xs) < tree.min_contexts or len(set(xs)) < 2:
            continue
        left = set(xs)
        while left:
            best = min(left, key=lambda x: (-xs.count(x), x))
            pattern = best.split()
            mine = {x for x in left if sum(a == b for a, b in zip(x.split(), pattern)) >= tree.min_agreement * leaf[0]}
            template |= {x: (leaf, best) for x in mine}
            left -= mine
    of = lambda x: template.get(x, x)
    before, after = {}, {}
    for x, b, a in lines:
        before.setdefault(of(x), set()).add(of(b))
        after.setdefault(of(x), set()).add(of(a))
    gone = {x for x, _, _ in lines if len(before[of(x)] - {None}) >= tree.min_contexts and len(after[of(x)] - {None}) >= tree.min_contexts}
    return [t if t is None else "\n".join(x for x in t.split("\n") if not (x.split() and masked(x) in gone)) for t in docs]


def corpus():
    rng = random.Random(2)
    word = lambda: f"w{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}{rng.choice('uvwxyz')}"
    line = lambda n: " ".join(word() for _ in range(n))
    docs = []
    for i in range(60):
        body = [line(rng.choice([3, 9, 14])) for _ in range(4)]
        body.insert(2, f"Page {i} of 99 printed on 2024-01-{i % 28 + 1}")
        if i % 2:
            body.insert(1, f"Posted by the user {word() if i % 4 == 1 else 'anna'} in the general news section today")
        body.insert(3, f"{i} 20 30 {i}.5 17 2001")
        if i % 3 == 0:
            body.append("All rights reserved by us")
        docs.append("\n".join(body))
    docs += [docs[7]] * 9  # copies keep their own lines
    docs += ["only this one line is here"] * 9 + [None, "", "\n \n", "Read more"]
    return docs


@pytest.mark.parametrize("elected", [16, 1])
def test_equals_brute_force(spark, elected):
    docs, tree = corpus(), lt.Tree(elected=elected)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, h string")
    got = {r.doc_id: r.text for r in lt.drop_lines(df, tree=tree).collect()}
    assert lt.drop_lines(df, tree=tree).columns == df.columns
    want = brute(docs, tree)
    assert [got[i] for i in range(len(docs))] == want
    assert not any("All rights" in (t or "") or "printed" in (t or "") or "Posted" in (t or "") for t in want)
    assert want[60:69] == [want[7]] * 9 and len(want[7].split("\n")) == 5 and want[69] == docs[69]
    for r in lt.report(df, tree=tree).collect():
        assert r.kept == want[r.doc_id]
        lines = (docs[r.doc_id] or "").split("\n")
        assert r.n_lines == (0 if docs[r.doc_id] is None else len(lines))
        assert r.n_dropped == (0 if r.kept == docs[r.doc_id] else len(lines) - len(want[r.doc_id].split("\n")))


def test_a_leaf_holds_any_number_of_templates(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") for _ in range(6))
    tails = [[word() for _ in range(8)] for _ in range(40)]
    docs = []
    for k, tail in enumerate(tails):
        for _ in range(6 if k % 2 else 2):  # half of the templates recur too seldom
            docs.append("\n".join([" ".join(word() for _ in range(30)), " ".join(["Sent from my own", word(), *tail]), " ".join(word() for _ in range(30))]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: len(r.text.split("\n")) for r in lt.drop_lines(df).collect()}
    seldom = {i for i, t in enumerate(docs) if sum(t.split("\n")[1].split()[5:] == u.split("\n")[1].split()[5:] for u in docs) == 2}
    assert len(seldom) == 40 and got == {i: 3 if i in seldom else 2 for i in range(len(docs))}


def test_blocks_of_several_lines_go_and_copies_stay(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("bcdfghklmnprst") for _ in range(6)) for _ in range(n))
    block = [line(9), line(12), line(7)]
    bodies = [[line(14) for _ in range(6)] for _ in range(12)]
    docs = [b[:3] + block + b[3:] if i % 2 else b + block for i, b in enumerate(bodies)]
    base = [line(14) for _ in range(20)]
    near = []
    for i in range(8):  # near copies, each with two lines of its own
        own = list(base)
        own[2 * i], own[19 - i] = line(14), line(14)
        near.append(own)
    texts = ["\n".join(d) for d in docs + near] + ["\n".join(docs[0])] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in lt.drop_lines(df).collect()}
    assert [got[i] for i in range(12)] == bodies and got[22] == bodies[0]
    assert [got[12 + i] for i in range(8)] == near


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lt.drop_lines(none).count() == 0 == lt.report(none).count()
