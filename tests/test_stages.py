"""The ladder of fallbacks, prompts, erased logs and the view of results."""

import glob

import pytest
from pyspark.sql import functions as F

from foliant.operators import ladder, prompts
from foliant.operators.translation import CallingProvider, OfflineProvider
from foliant.sources import epub, store

BLOCKS = ["<p> One <b>two</b> &amp; three</p>", "<p> </p>", "<p>four</p>"]


def climb(spark, call):
    d = spark.createDataFrame([("c", BLOCKS), ("d", ["<i></i>"])], "chunk string, blocks array<string>")
    return {(r.chunk, r.block_idx): (r.rung, r.texts) for r in ladder.translate(d, ["chunk"], "blocks", CallingProvider(call, 2)).collect()}


def test_nothing_lost(spark):
    got = climb(spark, lambda texts: [t.upper() for t in texts])
    assert got[("c", 0)] == ("chunk", [" ONE ", "TWO", " &amp;AMP; THREE"])
    assert got[("c", 1)] == ("none", []) == got[("d", 0)] and got[("c", 2)] == ("chunk", ["FOUR"])


def test_a_lost_mark_sends_every_block_of_the_chunk_down(spark):
    said = []

    def call(texts):
        said.extend(texts)
        return [t.replace("【2】", "") if "【" in t else "【7】 " + t for t in texts]

    got = climb(spark, call)
    assert got[("c", 0)][0] == got[("c", 2)][0] == "block" and got[("c", 2)][1] == ["four"]


def test_a_block_without_its_marks_is_translated_text_by_text(spark):
    got = climb(spark, lambda texts: [t.replace("⟦1⟧", "") if "⟦" in t else f"<{t}>" for t in texts])
    assert got[("c", 0)] == ("segment", [" &lt;One&gt; ", "&lt;two&gt;", " &lt;&amp;amp; three&gt;"])
    assert got[("c", 2)] == ("block", ["four"])


def test_the_offline_provider_on_the_ladder(spark):
    d = spark.createDataFrame([(1, BLOCKS)], "chunk long, blocks array<string>")
    assert {r.rung for r in ladder.translate(d, ["chunk"], "blocks", OfflineProvider()).collect()} <= {"none", "chunk", "block", "segment"}
    assert ladder.translate(d.limit(0), ["chunk"], "blocks", OfflineProvider()).collect() == []


def test_prompts(spark):
    d = spark.createDataFrame([([("Wien", "Bécs"), ("Klein", ""), ("Rom", None)], ["tokens", "omission"], ["Wien"], "t")], "g array<struct<term: string, rendering: string>>, flags array<string>, missing array<string>, text string")
    no = F.lit(False)
    row = d.select(
        prompts.terms(F.col("g")).alias("terms"), prompts.terms(F.slice("g", 1, 0)).alias("none"), prompts.problems(F.col("flags"), no, no, F.lit(True), F.col("missing")).alias("problems"),
        prompts.problems(F.slice("flags", 1, 0), F.lit(None).cast("boolean"), no, no, F.slice("missing", 1, 0)).alias("fine"),
        prompts.with_context(F.col("text"), F.lit("before"), F.lit("")).alias("said"), prompts.with_context(F.col("text"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("bare"),
    ).first()
    assert row.terms.split("\n")[1:] == ['- "Wien" -> "Bécs"', '- "Klein" (keep one consistent rendering)', '- "Rom" (keep one consistent rendering)'] and row.none == ""
    assert [x[:12] for x in row.problems.split("\n")] == ["KNOWN PROBLE", "- Part of th", "- The text r", "- These name", "- A text-seg", "", ""] and row.fine == ""
    assert row.said == 'PRECEDING CONTEXT (for continuity only, do not translate):\n"""before"""\n\nTEXT TO TRANSLATE:\nt' and row.bare == "t"


@pytest.mark.parametrize("kept", [True, False])
def test_erasing_rewrites_only_the_files_that_hold_the_user(spark, tmp_path, kept):
    path, schema = f"{tmp_path}/log", "n long, user string"
    lines = [['{"n": 1, "user": "a"}', '{"n": 2, "user": "b"}', "torn {", '{"n": 3}'], ['{"n": 4, "user": "b"}'], ['{"n": 5, "user": "a"}'] * 3 if kept else ['{"n": 5, "user": "b"}']]
    for part in lines:
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(path)
    before = {f: open(f).read() for f in glob.glob(f"{path}/part-*")}
    held = {f for f, text in before.items() if '"a"' in text}
    assert store.erase(spark, path, F.col("user") == "a", schema) == (len(held), 4 if kept else 1)
    after = {f: open(f).read() for f in glob.glob(f"{path}/part-*")}
    assert all(after[f] == text for f, text in before.items() if f not in held)
    assert sorted(x for text in after.values() for x in text.splitlines()) == sorted(x for part in lines for x in part if '"a"' not in x)
    assert [x for text in after.values() for x in text.splitlines() if x.startswith(("torn", '{"n": 3'))] == ["torn {", '{"n": 3}']
    assert store.erase(spark, path, F.col("user") == "a", schema) == (0, 0)
    assert {r.n for r in store.records(spark, path, schema).collect()} == ({2, 3, 4} if kept else {2, 3, 4, 5})


def test_results_beside_originals(spark):
    original = spark.createDataFrame([("b", 0, "x", "<html><body><h1>Old</h1></body></html>"), ("b", 3, "x", "second"), ("b", 1, "y", "gone")], "path string, spine_pos long, href string, content string")
    done = spark.createDataFrame([("b", 0, "x", "<body class='k'><h2> Új  cím </h2></body>"), ("b", 1, "z", "plain")], original.schema)
    got = sorted(map(tuple, epub.result_view(done, original).collect()))
    assert got == [("b", "x", "Új cím", "<h1>Old</h1>", "<h2> Új  cím </h2>"), ("b", "z", "Fejezet 2", "", "plain")]
