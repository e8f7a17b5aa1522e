"""Terms of a corpus: capitalised names, counted, told from sentence openers, merged."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T

_TERM = r"(?<![A-Za-z0-9_])" + fixed.PROPER_NOUN + r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def occurrences(docs: DataFrame, book: str, doc_id: str, text: str = "text") -> DataFrame:
    """book, doc_id, pos, term, initial: every candidate and whether it opens a sentence or line."""
    clean = T.strip_tags(F.col(text))
    marked = docs.select(book, doc_id, F.split(F.regexp_replace(clean, _TERM, "\u0001$1\u0002"), "\u0001").alias("parts"))
    pairs = F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("hit"), F.get("parts", i).alias("before")))
    hit = marked.select(book, doc_id, F.posexplode(pairs).alias("pos", "x"))
    before = F.replace(F.col("x.before"), F.lit("\u0002"), F.lit(""))
    bare = F.rtrim(before, F.lit(T.WS_CHARS))
    gap = F.substr(before, F.length(bare) + 1)
    last = F.right(bare, F.lit(1))
    initial = (last == "") | gap.contains("\n") | F.lit(fixed.SENTENCE_END).contains(last)
    return hit.where(F.col("x.hit").isNotNull()).select(book, doc_id, "pos", F.substring_index("x.hit", "\u0002", 1).alias("term"), initial.alias("initial"))


def counts(found: DataFrame, book: str, doc_id: str) -> DataFrame:
    """book, term, n, middle, first (its first place)."""
    return found.groupBy(book, "term").agg(F.count("*").alias("n"), F.sum((~F.col("initial")).cast("long")).alias("middle"), F.min(F.struct(doc_id, "pos")).alias("first"))


def is_opener() -> Column:
    return (F.col("n") >= 2) & (F.col("middle") / F.col("n") < fixed.TERM_MIN_MIDDLE)


def top_terms(counted: DataFrame, book: str, limit: int = fixed.TERM_LIMIT) -> DataFrame:
    """book, name, rank: the commonest names, openers dropped and stripped from the front.

    Ties go to the earlier first place. The limit is the report's size.
    """
    # all branches need all counts and filter on them, so the counts are shuffled once and reused
    lone = F.col("first").isNotNull() & F.when(is_opener(), ~F.col("term").contains(" ")).otherwise(False)
    openers = counted.where(lone).select(book, F.col("term").alias("word"), F.lit(True).alias("opens"))
    kept = counted.where(~is_opener() & (F.col("term").contains(" ") | (F.col("n") >= fixed.TERM_MIN_COUNT))).withColumn("words", F.split("term", " "))
    # a name begins at its first word that is no opener, at the latest at its last; words meet openers one by one
    placed = kept.select(book, "term", F.size("words").alias("size"), F.posexplode("words").alias("place", "word")).join(openers, [book, "word"], "left")
    begins = placed.groupBy(book, "term").agg(F.coalesce(F.min(F.when(F.col("opens").isNull(), F.col("place"))), F.max("size") - 1).alias("start"))
    named = kept.join(begins, [book, "term"]).withColumn("name", F.array_join(F.slice("words", F.col("start") + 1, F.size("words")), " "))
    named = named.where(F.col("name").rlike("^[A-Z]"))
    best = named.groupBy(book, "name").agg(F.max(F.struct(F.col("n"), F.struct(*(-F.col(f"first.{c}") for c in named.schema["first"].dataType.names)).alias("at"))).alias("best"))
    order = Window.partitionBy(book).orderBy(F.desc("best"))
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select(book, "name", F.col("best.n").alias("n"), "rank")


def merge(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """(term, rendering): an incoming rendering wins, an empty one only adds the term."""
    b, i = base.select("term", F.col("rendering").alias("b")), incoming.select("term", F.col("rendering").alias("i"))
    return b.join(i, "term", "full").select("term", F.coalesce(F.nullif("i", F.lit("")), "b", F.lit("")).alias("rendering"))


def _blocks(glossary: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Terms with their renderings, as many at a time as take so many bytes."""
    held, size = [], 0
    for r in glossary.where("rendering <> '' AND term <> ''").select("term", "rendering").distinct().toLocalIterator():
        held.append((r.term, r.rendering))
        size += len(r.term) + len(r.rendering) + 100
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanned(pairs: DataFrame, terms: list[tuple[str, str]], key: str, source: str, target: str) -> DataFrame:
    """key, target and the terms (with renderings) that occur in the source, for texts that have any."""
    kind, sent = pairs.schema[key].dataType.simpleString(), pairs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for term, rendering in sent.value:
            machine.add_word(term, [*machine.get(term, []), (term, rendering)])
        machine.make_automaton()
        for batch in batches:
            found = [list({x for _, hits in machine.iter(text) for x in hits}) if text else [] for text in batch.column(1).to_pylist()]
            some = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            terms_ = pa.array([[{"term": t, "rendering": r} for t, r in x] for x in found if x], pa.list_(pa.struct([("term", pa.string()), ("rendering", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(2).take(some), terms_], ["key", "target", "found"])

    return pairs.select(key, source, target).mapInArrow(run, f"key {kind}, target string, found array<struct<term: string, rendering: string>>")


def missing_terms(pairs: DataFrame, glossary: DataFrame, key: str, source: str, target: str, block_bytes: int = 8 << 20) -> DataFrame:
    """(key, term) where the source has the term anywhere and the target lacks its rendering.

    An automaton of all terms (in blocks of bounded bytes, a pass each) reads every source once, however many terms there are.
    Renderings are looked for in the same task, so no text is shuffled: only keys and terms are. Null texts have no terms and lack every rendering.
    """
    spark, out = pairs.sparkSession, None
    for block in _blocks(glossary, block_bytes):
        met = _scanned(pairs, block, key, source, target)
        lacking = F.filter("found", lambda x: ~F.coalesce(T.mentions(F.col("target"), x["rendering"]), F.lit(False)))
        told = met.select(F.col("key").alias(key), F.explode(F.array_distinct(F.transform(lacking, lambda x: x["term"]))).alias("term"))
        out = told if out is None else out.unionByName(told)
    return spark.createDataFrame([], f"{key} {pairs.schema[key].dataType.simpleString()}, term string") if out is None else out.distinct()
