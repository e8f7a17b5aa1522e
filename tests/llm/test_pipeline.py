import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import mixing


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with planted cases, and a benchmark, as tables."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(x) for x in ("bcdfgklm", "aeiouy", "bcdfgklmnp", "aeiouy", "rstn"))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(25) for _ in range(5)]
    rows, kind = [], {}

    def add(t, what, source="s"):
        i = len(rows)
        rows.append((i, t, "en", source, len(t or ""), "extra"))
        kind[i] = what

    for i in range(120):
        add(text(120) + "\n" + text(60), "clean", f"s{i % 4}")
    for i in range(30):
        add("\n".join([text(80), "Subscribe to our weekly letter today number " + str(i), text(70)]), "boilerplate", f"s{i % 4}")
    for _ in range(4):
        base = text(200).split()
        for c in range(5):
            copy = list(base)
            for _ in range(0 if c < 2 else 2):
                copy[rng.randrange(200)] = word()
            add(" ".join(copy), "first" if c == 0 else "copy")
    for q in items:
        add(text(60) + " " + q + " " + text(60), "leak")
    for t in ("too short", "", None, "same again and " * 60):
        add(t, "bad")
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __size string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, kind


def test_stages_do_what_they_say(spark, sf_dir):
    at, rows, kind = sf_dir
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stay = set(kind)
    for (_, step), gone in zip(corpus_pipeline.STAGES[:4], ("bad", None, "copy", "leak")):
        before = docs.columns
        docs = corpus_pipeline.tools.stage(step(spark, docs, at))
        assert docs.columns == before
        stay -= {i for i, k in kind.items() if k == gone}
        assert {r.doc_id for r in docs.collect()} == stay
    for r in docs.collect():
        lines = (rows[r.doc_id][1] or "").split("\n")
        assert r.text == "\n".join(x for x in lines if "Subscribe" not in x)


def test_run_and_reruns(spark, sf_dir):
    at, rows, kind = sf_dir
    got = corpus_pipeline.run(spark, at).collect()
    want = {i for i, k in kind.items() if k in ("clean", "boilerplate", "first")}
    assert {r.doc_id for r in got} <= want and len(got) > 0.8 * len(want)
    taken = sum(r.copies * len(re.findall(r"\S+", r.text)) for r in got)
    sizes = sum(180 if kind[i] == "clean" else 150 if kind[i] == "boilerplate" else 200 for i in want)
    assert abs(taken - 1.5 * sizes) < 1000
    again = corpus_pipeline.run(spark, at).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_stages_take_odd_tables(spark, sf_dir):
    at, _, _ = sf_dir
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "x " * 400_000, "en", None, 1), (3, "\n" * 1000, "en", "s", 1), (4, "a b\n" * 3000, "en", "s", 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, step in corpus_pipeline.STAGES:
            assert step(spark, docs, at).count() <= len(rows)
