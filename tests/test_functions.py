"""Known values of the text, price, chunk and check functions."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunking, cost, glossary, quality
from foliant.sources import html


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_metering(spark):
    html_text = ["<p>Hello <b>world</b> &amp; 😀</p>", "<p>  Café </p>"]
    n = sum(one(spark, T.visible_chars(T.plain_text(F.col("h"))), h=h) for h in html_text)
    assert n == 19
    assert [one(spark, cost.credits(F.col("n")), n=n) for n in (0, 1, 1000, 1001)] == [0, 1, 1, 2]
    assert [one(spark, cost.tier(F.col("n")), n=n) for n in (150_000, 150_001, 3_000_000, 3_000_001)] == [1, 2, 6, None]


def test_lengths(spark):
    assert one(spark, T.utf16_length(F.col("s")), s="a😀") == 3
    assert one(spark, T.trim(F.col("s")), s=" ﻿ a b　") == "a b"


def test_chunks():
    assert chunking.pack([8000, 8000], 8000) == [0, 1]
    assert chunking.pack([0, 5, 0, 4, 2, 0], 10) == [0, 0, 0, 0, 1, 1]


def test_prices(spark):
    def usd(i, c, o):
        return one(spark, cost.usd("gemini-3.6-flash", F.col("i"), F.col("c"), F.col("o")), i=i, c=c, o=o)

    assert usd(1_000_000, 0, 1_000_000) == pytest.approx(9.0)
    assert usd(100, 200, 0) == pytest.approx(200 / 1e6 * 0.15)
    assert one(spark, cost.price_profile(F.col("m")), m="gemini-3.5-flash-lite-001") == "gemini-3.5-flash-lite"
    assert one(spark, cost.cents(F.col("u")), u=0.011) == 2


def test_eta(spark):
    def told(done, total, mean, workers):
        return one(spark, cost.eta(F.col("d"), F.col("t"), F.col("m"), F.col("w"))["eta_ms"], d=done, t=total, m=mean, w=workers)

    assert told(4, 10, 2000.0, 1) == 12000.0
    assert told(4, 10, 2000.0, 4) == 3000.0
    assert told(9, 10, 2000.0, 4) == 2000.0
    assert told(10, 10, 2000.0, 4) is None


def test_terms(spark):
    text = "He met Klein. He saw Klein. After that, Captain Klein left. He met Klein again.\nAfter all He was there."
    docs = spark.createDataFrame([("b", 1, text)], "source string, doc_id long, text string")
    counted = glossary.counts(glossary.occurrences(docs, "source", "doc_id"), "source", "doc_id")
    names = {r.name for r in glossary.top_terms(counted, "source").collect()}
    assert "Klein" in names and "Captain Klein" in names and "After" not in names


def test_checks(spark):
    assert one(spark, quality.guard(F.col("s"), F.col("t"), F.col("t")), s="x", t="⟦1⟧") == "residual"
    assert one(spark, quality.guard(F.col("s"), F.col("t"), F.col("t")), s="x", t="Jó napot") is None

    def routed(flags, score, iteration, mode="balanced"):
        r = one(spark, quality.route(F.col("f"), F.col("s"), F.lit(False), F.lit(False), F.col("i"), mode), f=flags, s=score, i=iteration)
        return r.action, r.deep, r.back_translate

    assert routed(["omission"], 5, 2) == ("accept", False, False)
    assert routed(["omission"], 5, 0, "fidelity") == ("refine", True, True)
    assert routed([""], 2, 1) == ("refine", True, False)
    assert routed(["glossary"], 5, 0) == ("refine", False, False)
    assert routed([""], 4, 0) == ("accept", False, False)


def test_marks(spark):
    assert [tuple(x) for x in one(spark, T.split_segments(F.col("p")), p="pre ⟦ 0 ⟧a⟦1⟧b")] == [(0, "pre a"), (1, "b")]
    assert [tuple(x) for x in one(spark, T.split_blocks(F.col("p")), p="pre【0】\na【2】b")] == [(0, "\na"), (2, "b")]
    assert one(spark, T.resolve_href(F.lit("OEBPS/text"), F.col("h")), h="./../img//a.png") == "OEBPS/img/a.png"
    assert one(spark, T.clean_title(F.col("t")), t=" \x07a\n b ") == "a b"


def test_codes(spark):
    assert one(spark, T.unbase64url(T.base64url(F.col("s").cast("binary"))).cast("string"), s="ű?>~") == "ű?>~"
    assert one(spark, T.hmac_sha256(b"key")(F.col("s")), s="The quick brown fox jumps over the lazy dog") == "97yD9DBThCSxMpjmqm-xQ-9NWaFJRhdZl0edvC0aPNg"


def test_blocks():
    assert html.blocks_of("<body><li>a<p>b</p></li><p>c <em>d</em><script>'</p>'</script></p><h1>e") == ["b", "c <em>d</em>", "e"]


def test_segments(spark):
    segments = html.text_segments(F.col("h"))
    assert [tuple(x) for x in one(spark, segments, h="<p> a <b>b</b>\n</p>")] == [(" ", "a", " "), ("", "b", "")]
    back = html.restore_segments(segments, T.split_segments(F.col("t")))
    assert one(spark, back, h="<p> a <b>b</b></p>", t="⟦0⟧x<y⟦1⟧z") == [" x&lt;y ", "z"]
    assert one(spark, back, h="<p> a <b>b</b></p>", t="⟦0⟧x") is None
    assert one(spark, html.reserialise(F.col("o"), F.col("b")), o="<?xml version='1'?>\n<!DOCTYPE html>\n<html/>", b="<html>x</html>").startswith("<?xml")


def test_deep_and_odd_pages():
    from foliant.sources import html

    assert html.blocks_of("<div>" * 10_000 + "<p>x<b>y</p>" + "</div>" * 10_000) == ["x<b>y</b>"]
    assert html.blocks_of("<body><ul><li>a<li>b</ul><td><p>q</p>z</td><p>un<p>closed") == ["a", "b", "q", "un", "closed"]
    assert html.blocks_of("") == []
