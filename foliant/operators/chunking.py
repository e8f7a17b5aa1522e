"""Books as ordered documents, documents as blocks (lines), blocks packed into chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import ordered_scan
from foliant.sources import store


def pack(sizes, budget: int) -> list[int]:
    """Chunk number of each block: a block that would pass the budget starts a new chunk, and a
    chunk that reaches it is closed; empty blocks never open or close one by themselves."""
    out, chunk, held = [], 0, 0
    for n in sizes:
        if held > 0 and held + n > budget:
            chunk, held = chunk + 1, 0
        out.append(chunk)
        held += n
        if held >= budget:
            chunk, held = chunk + 1, 0
    return out


def packed(sizes: Column, budget: int) -> Column:
    """pack() over an array of sizes: only the sizes go to Python, and no row meets another."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else pack(x, budget))

    return run(sizes)


def chunks(docs: DataFrame, budget: int = fixed.CHUNK_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: the document's other columns, ordinal, first_block, n_blocks, n_chars
    (UTF-16 units of the blocks), chunk_text (blocks by line), prior_text (the document's chunk before, null for the first)
    and last (whether it ends the document)."""
    rest = [c for c in docs.columns if c != text]
    d = docs.select(*rest, F.split(F.col(text), "\n").alias("__blocks"))
    d = d.withColumn("__sizes", F.transform("__blocks", T.utf16_length))
    d = d.withColumn("__ord", packed(F.col("__sizes"), budget))
    d = d.withColumn("ordinal", F.explode(F.array_distinct("__ord")))
    first = F.array_position("__ord", F.col("ordinal"))
    d = d.withColumn("__first", first).withColumn("__n", F.size(F.filter("__ord", lambda x: x == F.col("ordinal"))))
    mine = F.slice("__sizes", F.col("__first").cast("int"), F.col("__n"))
    before = F.array_position("__ord", F.col("ordinal") - 1).cast("int")
    return d.select(
        *rest,
        F.col("ordinal").cast("long").alias("ordinal"),
        (F.col("__first") - 1).cast("long").alias("first_block"),
        F.col("__n").cast("long").alias("n_blocks"),
        F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_chars"),
        F.array_join(F.slice("__blocks", F.col("__first").cast("int"), F.col("__n")), "\n").alias("chunk_text"),
        F.when(F.col("ordinal") > 0, F.array_join(F.slice("__blocks", before, F.col("__first").cast("int") - before), "\n")).alias("prior_text"),
        (F.col("ordinal") == F.element_at("__ord", -1)).alias("last"),
    )


def tail(text: Column, n: int = fixed.CONTEXT_TAIL) -> Column:
    return F.right(text, F.lit(n))


def previous_context(chunked: DataFrame, book: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """book, doc_id, ordinal, context: the end of the chunk before, across documents of a book.

    Inside a document the chunk before is at hand where the document is cut, so nothing is shuffled for it. Only first
    chunks look into another document: one row a document (its id, and the end of its last chunk) is scanned in order.
    """
    ends = chunked.select(book, doc_id, "ordinal", tail(T.collapse(F.col("prior_text"))).alias("context"), F.when(F.col("last"), tail(T.collapse(F.col("chunk_text")))).alias("end"))
    path = store.folder(chunked.sparkSession, "ends")
    ends.write.parquet(path)
    ends = chunked.sparkSession.read.schema(ends.schema).parquet(path)
    before = ordered_scan.scan(ends.where("end is not null").select(book, doc_id, "end"), book, [doc_id], last=["end"]).select(book, doc_id, "last_end")
    first = ends.where("ordinal = 0").join(before, [book, doc_id]).select(book, doc_id, "ordinal", F.col("last_end").alias("context"))
    return ends.where("ordinal > 0").select(book, doc_id, "ordinal", "context").unionByName(first)


def first_chunks(chunked: DataFrame, book: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Each book's first chunk, found by a two-phase minimum."""
    at = F.struct(F.col(doc_id), F.col("ordinal"))
    return chunked.groupBy(book).agg(F.min_by("chunk_text", at).alias("chunk_text"), F.min(at).alias("at")).select(book, F.col(f"at.{doc_id}").alias(doc_id), "at.ordinal", "chunk_text")


def content_chapters(chunked: DataFrame, book: str = "source", doc_id: str = "doc_id", least: int = fixed.SAMPLE_MIN_WORDS, most: int = fixed.SAMPLE_MAX_WORDS) -> DataFrame:
    """The sample of each book: its first chapter of prose with enough words (else with any words,
    else any chapter with enough, with any, the first), up to the word limit, one chunk at least."""
    sized = chunked.select(book, doc_id, "ordinal", T.word_count(F.col("chunk_text")).alias("words"), linked_words(F.col("chunk_text")).alias("linked"))
    path = store.folder(chunked.sparkSession, "sized")
    sized.write.parquet(path)  # read twice, and texts are cut and counted once
    sized = chunked.sparkSession.read.schema(sized.schema).parquet(path)
    chapters = sized.groupBy(book, doc_id).agg(F.sum("words").alias("w"), F.sum("linked").alias("l"))
    prose = ~((F.col("w") > 0) & (F.col("l") / F.nullif(F.col("w"), F.lit(0)) >= fixed.NAVIGATION_RATIO))
    rank = F.when(F.coalesce(prose, F.lit(True)) & (F.col("w") >= least), 0).when(F.coalesce(prose, F.lit(True)) & (F.col("w") > 0), 1).when(F.col("w") >= least, 2).when(F.col("w") > 0, 3).otherwise(4)
    best = chapters.groupBy(book).agg(F.min(F.struct(rank.alias("rank"), F.col(doc_id))).alias("best")).select(book, F.col(f"best.{doc_id}").alias(doc_id))
    own = sized.join(best, [book, doc_id])
    upto = F.sum("words").over(Window.partitionBy(book, doc_id).orderBy("ordinal"))
    kept = own.withColumn("upto", upto).where((F.col("upto") <= most) | (F.col("ordinal") == 0))
    return kept.groupBy(book, doc_id).agg(F.count("*").alias("n_chunks"), F.sum("words").alias("words"))


def linked_words(html: Column) -> Column:
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<a(?![A-Za-z0-9_])[^>]*>(.*?)</a>"), 1)
    return F.aggregate(F.transform(inner, T.word_count), F.lit(0).cast("long"), lambda a, x: a + x)


def spread(df: DataFrame, order: list[str], size: int, fit: Column | None = None) -> DataFrame:
    """`size` rows evenly spread over the order (all, if there are no more) of those that are fit."""
    path = store.folder(df.sparkSession, "spread")
    df.write.parquet(path)  # counted, sampled, dealt and read: what its columns cost is paid once
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    df = df if fit is None else df.where(fit)
    n = df.count()
    if n <= size:
        return df
    wanted = df.sparkSession.range(size).select(F.floor(F.col("id").cast("double") * n / size).alias("__at"))
    one = df.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1))
    numbered = ordered_scan.scan(one, "__all", order, sums=["__one"]).withColumnRenamed("before___one", "__at")
    return numbered.join(F.broadcast(wanted), "__at", "left_semi").select(*df.columns)
