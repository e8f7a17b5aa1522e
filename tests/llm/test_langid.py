import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import langid
from foliant.llm.langid import Training


def test_gradients_equal_differences():
    t = Training(hidden=3, embedding=2)
    net = langid.Network(["a", "b", "c"], t)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, live = langid.columns([b"abc", b"d", b"efgh"])
    label, weight = np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])
    _, g = net.gradients(x, live, label, weight)
    rng = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(6):
            at = (rng.choice(np.frombuffer(b"abcdefgh", np.uint8)), rng.integers(value.shape[1])) if name == "embed" else tuple(rng.integers(s) for s in value.shape)
            old, loss = value[at], []
            for d in (1e-2, -1e-2):
                value[at] = old + d
                loss.append(net.gradients(x, live, label, weight)[0])
            value[at] = old
            assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[name][at], abs=2e-4, rel=0.03), name


def test_pooling_equals_word_by_word():
    net = langid.Network(["a", "b"], Training())
    texts = [b"one two one", b"", b"x" * 100 + b" y", b"two"]
    got = langid.Reader(net, remember=1).read(texts)
    for text, row in zip(texts, got):
        probs = [net.probabilities(*langid.columns([s]))[:, 0] for w in text.split() for s in langid.pieces(w)]
        want = np.concatenate(probs).mean(0) if probs else np.zeros(2)
        assert row == pytest.approx(want, abs=1e-5)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(9001, None, "en"), (9002, " 12 \n 34", "en"), (9003, "the thing", None), (9004, "x" * 5000, "en")], docs.schema)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    small = Training(sample_docs=100, sample_words=2000, epochs=4)
    got = {r.doc_id: r for r in langid.identify(docs.union(more).withColumn("score", F.lit("x")), held_out=held, training=small).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth) + 4
    out = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].lang_pred == truth[i] for i in out if got[i].lang_pred != "und"]) > 0.97 and len(out) > 150
    assert (got[9001].lang_pred, got[9001].score, got[9002].lang_pred) == ("und", 0.0, "und")
    assert got[9003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(none).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(one).first().lang_pred == "und"
