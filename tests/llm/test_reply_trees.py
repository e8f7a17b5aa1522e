import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import reply_trees as rt

PIECES = st.sampled_from(["<|", "|>", "</s>", "[INST]", "[/INST]", "\\", "<|end|>\n", "<|turn|>", "\n", "a", "é", "user", "<", "|", "[", "<<SYS>>", "s>"])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(TEXT, st.just("assistant")), TEXT), max_size=5))
def test_round_trip_and_mask(turns):
    formatted, spans = rt.render(turns)
    assert rt.read_back(formatted) == turns
    assert [rt.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count("<|turn|>") == len(turns) == formatted.count("<|end|>")
    assert not any(c in rt.escape(t) for _, t in turns for c in ("</s>", "[INST]", "[/INST]"))


def brute_best(nodes, per_tree):
    kids, by = {}, {n["node"]: n for n in nodes}
    for n in nodes:
        kids.setdefault(n["parent"] if n["parent"] in by and by[n["parent"]]["tree"] == n["tree"] else None, []).append(n)
    paths = []

    def walk(n, path):
        path = [*path, n]
        if not kids.get(n["node"]):
            paths.append(path)
        for k in kids.get(n["node"], []):
            walk(k, path)

    for root in kids.get(None, []):
        walk(root, [])
    out = {}
    for p in paths:
        out.setdefault(p[0]["tree"], []).append(p)
    rank = lambda p: (-sum(x["score"] or 0 for x in p) / len(p), -len(p), p[-1]["node"])
    return {(t, p[-1]["node"]): [x["node"] for x in p] for t, ps in out.items() for p in sorted(ps, key=rank)[:per_tree]}


def test_paths_of_random_trees_equal_brute_force(spark):
    rng = random.Random(5)
    nodes = []
    for t in range(25):
        mine = []
        for i in range(rng.choice([1, 2, 9, 30])):
            parent = rng.choice(mine) if mine and rng.random() < 0.9 else rng.choice([None, "gone", "0-0"])
            mine.append(f"{t}-{i}")
            nodes.append({"tree": t, "node": mine[-1], "parent": parent, "role": "user", "text": "x", "score": rng.choice([None, 1.0, 2.0, 5.0]), "extra": 1})
    nodes[-1]["parent"] = nodes[0]["node"]
    df = spark.createDataFrame(nodes, "tree long, node string, parent string, role string, text string, score double, extra int")
    for k in (1, 3):
        got = {}
        for r in sorted(rt.chosen_paths(df, k).collect(), key=lambda r: r.depth):
            got.setdefault((r.tree, r.leaf), []).append(r.node)
        assert got == brute_best(nodes, k)


def test_conversations_with_ties_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, None, "b"), (None, 0, "user", "n"), (2, None, "user", "z"), (2, 0, "assistant", "</s>")]
    rows += [(3, i, "user", str(i)) for i in range(70)]
    made = rt.format_trees(rt.threads(spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, node string"))).collect()
    got = {r.tree: rt.read_back(r.formatted) for r in made}
    assert got[1] == [("user", "a"), ("assistant", ""), ("assistant", ""), ("", "b")]
    assert got[None] == [("user", "n")] and got[2] == [("user", "z"), ("assistant", "</s>")]
    assert got[3] == [("user", str(i)) for i in range(70)]
    assert {r.tree: r.n_turns for r in made} == {1: 4, None: 1, 2: 2, 3: 70}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rt.format_trees(rt.threads(none)).count() == 0
