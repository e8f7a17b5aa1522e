"""What must not be done again for each block, row or pass: it grew faster than the tables."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import cost, quality, speculation, translation
from foliant.plans import catalogue
from foliant.sources import epub, epub_source, store

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def kept(d):
    path = store.folder(d.sparkSession, "test")
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)


def test_blocks_of_a_draft_are_cut_once(spark):
    """Each row of a block carried all bodies of its chunk, three times over."""
    chunks = spark.createDataFrame([(1, ["one", "two", "", "three"])], "k long, blocks array<string>")
    told = translation.translate(chunks, ["k"], "blocks", translation.OfflineProvider(), save=kept)
    assert "Generate" not in plan(told)
    assert [r.target.split()[-1] if r.target else "" for r in told.where("source != ''").orderBy("block_idx").collect()] == ["ONE", "TWO", "THREE"]


def test_the_last_body_of_a_mark_counts_and_lost_marks_have_none(spark):
    class Odd(translation.Provider):
        def translate(self, df, source, out):
            return df.withColumn(out, F.when(F.col(source).contains("【"), F.lit("【2】\nfirst\n\n【0】\nzero\n\n【2】\nlast\n\n【99999999999】\nfar")).otherwise("alone"))

    chunks = spark.createDataFrame([(1, ["a", "b", "c"]), (2, None)], "k long, blocks array<string>")
    got = translation.translate(chunks, ["k"], "blocks", Odd(), save=kept).orderBy("block_idx").collect()
    assert [(r.k, r.target) for r in got] == [(1, "zero"), (1, "alone"), (1, "last")]


def test_words_with_marks_stay_as_they_are(spark):
    texts = ["【0】\nfirst Word", "a⟦1⟧b and ⟦2⟧ c", "x12】 y", "【】 z", "【3】5abc d", "⟦ 4 ⟧ e", "no mark ß", "⟧ f", "q【5】 g", "【6】 h", "", "【7⟧ i"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", cost.fake_translate(F.col("t")).alias("u")).orderBy("i").collect()
    marks = set(fixed.TOKEN_OPEN + fixed.TOKEN_CLOSE + fixed.BLOCK_OPEN + fixed.BLOCK_CLOSE)
    for row, text in zip(got, texts):
        words = "".join(c if c not in T.WS_CHARS else "\0" + c + "\0" for c in text).split("\0")
        upper = "".join(w if marks & set(w) else w.upper() for w in words)
        assert row.u.replace(f" {fixed.FAKE_PREFIX}", "").replace(fixed.FAKE_PREFIX, "") == upper


def test_trim_takes_all_white_space_of_the_ends(spark):
    df = spark.createDataFrame([("﻿  a b \n　",), ("​ a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.trim(F.col("t"))).collect()] == ["a b", "​ a", "", None]


def test_what_is_weak_is_told_once_a_payload(spark):
    """It was an expression over the whole payload, computed again for every block."""
    assert plan(catalogue.QUERIES["weak_scopes"](spark, SF)).count("regexp_replace") <= 4


def test_words_are_counted_once_a_text(spark):
    """A sample and the first chapters counted them again for each pass over the rows."""
    assert "regexp" not in plan(catalogue.QUERIES["spread_sample"](spark, SF))
    assert "regexp" not in plan(catalogue.QUERIES["first_content_chapter"](spark, SF))
    words = [("a b", 2), ("<p>é x</p> 漢字　y", 4), ("x" * 9 + "é" * 50_000, 1), (" ", 0), ("", 0), ("a < b", 3), (None, None)]
    df = spark.createDataFrame([(t, n) for t, n in words], "t string, n long")
    assert [r[0] for r in df.select(T.word_count(F.col("t"))).collect()] == [n for _, n in words]


def test_ranges_of_one_sequence_do_not_run_a_square_of_times(spark, monkeypatch):
    """Each range changes what the next starts from: all ranges that were left ran again in every round."""
    ran, save = [], store.save

    def counted(df, path, by):
        save(df, path, by)
        if "/folded-" in path:
            ran.append(df.select("__range").distinct().count())

    monkeypatch.setattr(store, "save", counted)

    def step(state, row):
        state["n"] = ((state["n"] or 1) * 3 + row["i"]) % 1009
        return str(state["n"])

    rows = spark.range(240).select(F.col("id").alias("i"))
    got = [r.decision for r in speculation.fold(rows, ["i"], step, range_rows=20).orderBy("i").collect()]
    n, want = None, []
    for i in range(240):
        n = ((n or 1) * 3 + i) % 1009
        want.append(str(n))
    assert got == want and sum(ran) <= 60  # 12 + 11 + ... + 1 = 78 before


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_a_delivery_writes_each_book_once(spark, monkeypatch):
    """its archives were made a second time for their paths alone, and read three times behind two joins of archives."""
    plans, rebuilt = [], epub.rebuilt
    monkeypatch.setattr(epub, "rebuilt", lambda *a, **k: plans.append(rebuilt(*a, **k)) or plans[-1])
    told = catalogue.QUERIES["epub_delivery"](spark, SF)
    assert [python_steps(p) for p in plans] == [2, 1] and python_steps(told) == 2 and "Join" not in plan(told)


def arrow_batches(df):
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return [r.n for r in df.mapInArrow(count, "n long").collect()]


def test_books_are_sent_together(spark):
    """a batch of its own for each book was dearer than the book; and chapters of a text went through two shuffles."""
    assert plan(catalogue.QUERIES["epub_spine"](spark, SF)).count("Aggregate") == 1
    chapters = spark.range(60).repartition(1).select(F.concat("id", F.lit(".epub")).alias("path"), F.lit("t").alias("title"), F.lit(0).alias("pos"), F.lit("c.xhtml").alias("href"), F.lit("<p/>").alias("content"))
    files = epub.written(chapters).coalesce(1)
    assert sum(arrow_batches(files)) == 60 and len(arrow_batches(epub.books(files))) == 1


def test_a_folder_of_books_is_read_in_batches_of_many(spark, tmp_path):
    """F12"""
    archive = epub._archive("t", [{"href": f"c{i}.xhtml", "content": "x"} for i in range(2)])
    for i in range(30):
        (tmp_path / f"{i}.epub").write_bytes(archive)
    reader = epub_source.Reader({"path": str(tmp_path)})
    assert [b.num_rows for share in reader.partitions() for b in reader.read(share)] == [60]
    big = [([{"a": i}], epub._BATCH_BYTES) for i in range(3)]
    assert [b.num_rows for b in epub.together(iter(big), pa.schema([("a", pa.int64())]))] == [1, 1, 1]


def test_a_text_is_written_again_only_when_it_changes(spark):
    """every draft was written with its blocks and payload five times, and once more as blocks, whatever became of it."""
    saved = []
    chunks = spark.createDataFrame([(1, ["settled " * 30, ""]), (2, ["q"] * 60), (3, ["a story of mine, as an AI"]), (4, [])], "k long, blocks array<string>")
    told = translation.translate(chunks, ["k"], "blocks", translation.OfflineProvider(), save=lambda d: saved.append(kept(d)) or saved[-1])
    rows = {(r.k, r.block_idx): (r.target, r.reason) for r in told.collect()}
    assert len(rows) == 63 and rows[1, 1][1] is None and rows[3, 0][1] == "refusal"
    assert {rows[2, i] for i in range(60)} == {(fixed.FAKE_PREFIX + 2 * fixed.FAKE_REFINE + "\nQ", None)}
    written = "".join(str(r) for t in saved for r in t.collect())
    assert (written.count("settled "), written.count("SETTLED")) == (30, 30)  # 330 and 180 before
    assert (written.count("'q'"), written.count("nQ")) == (180, 180)  # a draft, a refinement, and the blocks of the second
    assert (written.count("story"), written.count("STORY")) == (2, 1)  # refused: its first target is not kept


def test_a_judge_is_asked_once_about_each_draft_that_is_left(spark, tmp_path):
    """both ways from a verdict asked for it, and accepted drafts were judged again in the next round."""
    folder = str(tmp_path)

    class Strict(translation.CallingProvider):
        def refine(self, df, source, draft, out):
            return df.withColumn(out, F.replace(F.col(draft), F.lit("bad"), F.lit("good")))

        def judge(self, df, source, draft, out):
            at = df.columns.index(draft)

            def run(batches):
                for b in batches:
                    said = b.column(at).to_pylist()
                    for text in said:
                        with open(os.path.join(folder, os.urandom(8).hex()), "w") as f:
                            f.write(text)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(['{"score": 1}' if "bad" in t else '{"score": 5}' for t in said])], [*b.schema.names, out])

            return df.mapInArrow(run, df.withColumn(out, F.lit("")).schema)

    chunks = spark.createDataFrame([(1, ["one"]), (2, ["bad two"]), (3, ["x" * 300])], "k long, blocks array<string>")
    shorter = Strict(lambda texts: [t.replace("x" * 300, "x") for t in texts], 2)
    told = translation.translate(chunks, ["k"], "blocks", shorter, save=kept).orderBy("k").collect()
    assert [(r.k, r.target) for r in told] == [(1, "one"), (2, "good two"), (3, "x")]
    assert sorted((tmp_path / f).read_text().split("\n")[1] for f in os.listdir(folder)) == ["bad two", "good two", "one"]


def test_distinctive_characters_are_looked_for_before_words(spark):
    """words of two languages were looked for in every block, and what settles most of them came last."""
    texts = ["the and was were that", "THE and was were thát", "the and hogy nem egy", "short", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(quality.untranslated(F.col("t"), "en", "hu").alias("u"))
    assert plan(df).index(fixed.DISTINCTIVE["hu"]) < plan(df).index("the|and")
    assert [r.u for r in df.collect()] == [True, False, False, False, False, None]
