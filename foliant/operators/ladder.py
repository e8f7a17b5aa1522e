"""Translation of marked-up blocks by a ladder: the whole chunk, else every block of it alone, else the text nodes of a block.

A payload carries a mark for each block and for each text node. If a reply lost a mark of any block of a chunk, all blocks of that
chunk go down a rung and are translated again, one by one; a block whose reply still lacks a mark has its text nodes translated
one by one, which can lose nothing. Each rung is a stage over the rows that need it, so most rows see one call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators.translation import Provider
from foliant.sources import html


def _payload(texts: Column) -> Column:
    """The blocks that have text, each behind its own mark."""
    marked = F.transform(texts, lambda x, i: F.when(x != "", F.concat(F.lit(fixed.BLOCK_OPEN), i.cast("string"), F.lit(f"{fixed.BLOCK_CLOSE}\n"), x)))
    return F.array_join(F.array_compact(marked), "\n\n")


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _restored(segments: Column, reply: Column) -> Column:
    """The text nodes with what the reply says of each; null if it lacks one."""
    return _bound(T.split_segments(reply), lambda hits: html.restore_segments(segments, hits))


def translate(chunks: DataFrame, key: list[str], blocks: str, provider: Provider, save: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """key, block_idx, texts (translated text nodes, escaped, with the space around them), rung (none, chunk, block, segment).

    blocks is an array of HTML. Blocks without text keep their place and rung none. `save` writes a table and reads it again, so
    that a provider that costs money is called once a payload.
    """
    segments = F.transform(blocks, html.text_segments)
    d = chunks.select(*key, segments.alias("__segments"))
    d = d.withColumn("__texts", F.transform("__segments", lambda s: T.segment_payload(F.transform(s, lambda x: x["core"]))))
    d = save(provider.translate(d.withColumn("__source", _payload(F.col("__texts"))), "__source", "__draft"))

    def block(hits: Column) -> Column:
        return F.transform("__segments", lambda s, i: _bound(T.trim(T.body_of(hits, i)), lambda body: F.when(F.coalesce(body, F.lit("")) != "", _restored(s, body))))

    d = save(d.withColumn("__got", _bound(T.split_blocks(F.col("__draft")), block)))
    whole = F.forall(F.arrays_zip(F.col("__texts").alias("t"), F.col("__got").alias("g")), lambda x: (x["t"] == "") | x["g"].isNotNull())
    zipped = F.arrays_zip(F.col("__segments").alias("segments"), F.col("__texts").alias("text"), F.col("__got").alias("texts"))
    rows = d.withColumn("__whole", whole).select(*key, "__whole", F.posexplode(zipped).alias("block_idx", "x")).select(*key, "__whole", F.col("block_idx").cast("long").alias("block_idx"), "x.segments", "x.text", "x.texts")
    rows = save(rows)
    empty = F.col("text") == ""
    none = F.array().cast("array<string>")
    done = rows.where(F.col("__whole") | empty).select(*key, "block_idx", F.when(empty, none).otherwise(F.col("texts")).alias("texts"), F.when(empty, "none").otherwise("chunk").alias("rung"))

    alone = provider.translate(rows.where(~F.col("__whole") & ~empty).select(*key, "block_idx", "segments", "text"), "text", "__reply")
    clean = T.trim(F.regexp_replace("__reply", f"{fixed.BLOCK_OPEN}\\d+{fixed.BLOCK_CLOSE}", ""))
    alone = save(alone.withColumn("texts", _restored(F.col("segments"), clean)))
    done = done.unionByName(alone.where("texts is not null").select(*key, "block_idx", "texts", F.lit("block").alias("rung")))

    nodes = alone.where("texts is null").select(*key, "block_idx", F.posexplode("segments").alias("node", "s")).select(*key, "block_idx", "node", "s", F.col("s.core").alias("core"))
    nodes = save(provider.translate(nodes, "core", "__reply"))
    text = F.concat("s.leading", T.escape_entities(T.trim(F.coalesce("__reply", "core"))), "s.trailing")
    each = nodes.groupBy(*key, "block_idx").agg(F.sort_array(F.collect_list(F.struct("node", text.alias("text")))).alias("n"))  # the nodes of one block
    return done.unionByName(each.select(*key, "block_idx", F.transform("n", lambda x: x["text"]).alias("texts"), F.lit("segment").alias("rung")))
