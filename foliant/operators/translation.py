"""The translation stage: draft, local checks, judge, bounded refinement, fallback, guard, one retry.

A provider adds columns to a table of payloads, so it may be column expressions (the offline one)
or calls to a model inside tasks (`CallingProvider`). Rows that need no call are not sent to it.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import cost, quality

MAX_REFINEMENTS = 2


class Provider(ABC):
    """What a translator can do. Only `translate` is required."""

    #: Whether its columns are expressions: no row costs a call, so a judge may be given all.
    expressions = False

    @abstractmethod
    def translate(self, df: DataFrame, source: str, out: str) -> DataFrame:
        """df with the draft of the payload column."""

    def refine(self, df: DataFrame, source: str, draft: str, out: str) -> DataFrame:
        return df.withColumn(out, F.col(draft))

    def judge(self, df: DataFrame, source: str, draft: str, out: str) -> DataFrame:
        """df with a verdict as JSON (score 1 to 5), null without a judge."""
        return df.withColumn(out, F.lit(None).cast("string"))


class OfflineProvider(Provider):
    """Deterministic stand-in, all in column expressions."""

    expressions = True

    def __init__(self, terms: dict[str, str] | None = None):
        self.terms = terms

    def translate(self, df: DataFrame, source: str, out: str) -> DataFrame:
        return df.withColumn(out, cost.fake_translate(F.col(source), self.terms))

    def refine(self, df: DataFrame, source: str, draft: str, out: str) -> DataFrame:
        return df.withColumn(out, cost.fake_refine(F.col(draft)))

    def judge(self, df: DataFrame, source: str, draft: str, out: str) -> DataFrame:
        return df.withColumn(out, F.lit('{"score": 5}'))


class CallingProvider(Provider):
    """Sends payloads to a function from list of texts to list of texts, batch by batch in tasks.

    `concurrency` bounds the tasks that call at once.
    """

    def __init__(self, call: Callable[[list[str]], list[str]], concurrency: int = 4):
        self.call, self.concurrency = call, concurrency

    def translate(self, df: DataFrame, source: str, out: str) -> DataFrame:
        call, at = self.call, df.columns.index(source)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(call(batch.column(at).to_pylist()), pa.string())], [*batch.schema.names, out])

        schema = df.withColumn(out, F.lit("")).schema
        return df.repartition(self.concurrency).mapInArrow(run, schema)


def retry_delays(attempts: int = 5, base: float = 1.0, most: float = 30.0, jitter: Callable[[], float] = lambda: 1.0) -> list[float]:
    """Seconds to wait before each further attempt: doubled up to a cap, times a jitter in 0..1."""
    return [min(most, base * 2**i) * jitter() for i in range(attempts - 1)]


def _routed(d: DataFrame, provider: Provider, mode: str, pair: tuple[str, str], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Whether to refine a draft: the judge is asked about what passed the local length check, and the routing decides."""
    least, most = map(F.lit, quality.band(mode, *pair))
    d = d.withColumn("__flags", quality.flags(F.col("__source"), F.col("__draft"), least, most, F.lit(0)))
    omitted = F.array_contains("__flags", "omission")
    if provider.expressions or type(provider).judge is Provider.judge:
        judged = provider.judge(d, "__source", "__draft", "__verdict").withColumn("__verdict", F.when(~omitted, F.col("__verdict")))
    else:
        d = save(d.drop("__source")).withColumn("__source", T.block_payload(F.col("__blocks")))  # two ways lead from here
        judged = provider.judge(d.where(~omitted), "__source", "__draft", "__verdict")
        judged = judged.unionByName(d.where(omitted).withColumn("__verdict", F.lit(None).cast("string")))
    said = lambda name: F.coalesce(F.get_json_object("__verdict", f"$.{name}") == "true", F.lit(False))
    action = quality.route(F.col("__flags"), quality.score_of(F.col("__verdict")), said("omission"), said("accuracy"), F.lit(0), mode)["action"]
    return judged.withColumn("__refine", action == "refine").drop("__flags", "__verdict")


def _cut(d: DataFrame, key: list[str]) -> DataFrame:
    """key, block_idx, source, target, __again: a row a block of what is accepted; of what is to be refined one row, with its blocks and draft in `__again`."""
    refine = F.col("__refine")
    d = d.withColumns({"__hits": T.split_blocks(F.when(~refine, F.col("__draft"))), "__draft": F.when(refine, F.col("__draft"))})
    d = d.withColumn("__at", _places(F.transform("__hits", lambda x: x["index"]), F.coalesce(F.size("__blocks"), F.lit(0))))
    # each block leaves with its own body: an exploded row that carries all bodies of its chunk makes a square of them
    bodies = F.transform("__at", lambda i: F.get("__hits", i)["body"])
    empty = F.array().cast("array<string>")
    parts = F.arrays_zip(
        F.when(refine, empty).otherwise(F.col("__blocks")).alias("source"),
        F.when(refine, empty).otherwise(bodies).alias("target"),
        F.array_compact(F.array(F.when(refine, F.struct("__blocks", "__draft")))).alias("again"),
    )
    rows = d.select(*key, F.posexplode(parts).alias("block_idx", "__b"))
    return rows.select(*key, F.col("block_idx").cast("long").alias("block_idx"), "__b.source", T.trim(F.col("__b.target")).alias("target"), F.col("__b.again").alias("__again"))


def translate(chunks: DataFrame, key: list[str], blocks: str, provider: Provider, mode: str = "balanced", pair: tuple[str, str] = ("en", "hu"), save: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """key, block_idx, source, target, reason: one row per block of each chunk.

    Blocks whose mark got lost are translated alone, and so, once, are blocks that the guard
    refuses; a reason that is left says why the block failed. `save` writes a table and reads it
    again, so that a provider that costs money is called once a payload. A text and its draft are written
    once, and again only when refined, refused, or sent to a judge: what is accepted stays where it is.
    """
    payload = T.block_payload(F.col("__blocks"))
    blank = T.trim(F.col("source")) == ""
    reason = quality.guard(F.col("source"), F.col("target"), F.col("target"), pair)
    told = lambda r: r.withColumn("reason", F.when(~blank, reason))
    d = provider.translate(chunks.select(*key, F.col(blocks).alias("__blocks")).withColumn("__source", payload), "__source", "__draft")
    settled = []
    for left in reversed(range(MAX_REFINEMENTS + 1)):
        d = _routed(d, provider, mode, pair, save) if left else d.withColumn("__refine", F.lit(False))
        # a refused text is not needed again
        d = save(told(_cut(d, key)).withColumn("target", F.when(F.col("reason").isNull(), F.col("target"))))
        settled.append(d.where("__again is null").drop("__again"))
        if left:
            d = d.where("__again is not null").select(*key, "__again.*").withColumn("__source", payload)
            d = provider.refine(d, "__source", "__draft", "__better").withColumn("__draft", F.coalesce(F.nullif("__better", F.lit("")), "__draft")).drop("__better")
    rows = reduce(DataFrame.unionByName, settled)
    missed = F.col("target").isNull() & F.col("reason").isNull() & ~blank
    alone = told(save(_alone(rows.where(missed).drop("reason"), provider)))
    rows = rows.where(~missed).unionByName(alone)
    retried = save(_alone(rows.where("reason is not null").drop("reason"), provider)).withColumn("reason", reason)
    return rows.where("reason is null").unionByName(retried)


@F.pandas_udf(ArrayType(IntegerType()))
def _places(indices: pd.Series, sizes: pd.Series) -> pd.Series:
    """For each of so many blocks the place of the last hit with its index, null without one: only numbers go to Python."""

    def places(found, n: int) -> list[int | None]:
        last = {i: place for place, i in enumerate(() if found is None else found)}
        return [last.get(i) for i in range(n)]

    return pd.Series([places(*x) for x in zip(indices, sizes)])


def _alone(rows: DataFrame, provider: Provider) -> DataFrame:
    """Each block as a payload of its own, without marks."""
    return provider.translate(rows.drop("target"), "source", "target").withColumn("target", T.trim(F.regexp_replace("target", f"{fixed.BLOCK_OPEN}\\d+{fixed.BLOCK_CLOSE}", "")))
