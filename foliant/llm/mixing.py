"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, the source's target over
its size. The whole part is taken; the fractional parts meet in pairs, and of each pair words
move at random from one to the other until one part is 0 or 1. Words of the pair stay equal and
each part's expectation too, so a source's taken words differ from its target by less than one
document. Pairs meet in buckets of documents dealt by hash; each bucket leaves at most one open
part per source, and these are paired again in a tree of fixed fan-in until one is left.

Randomness is a hash of doc_id, size and a seed, and buckets are ordered by it: reruns agree
whatever the partitions. Defined cases: null and empty texts have size 0 and are never taken;
a null source is a source of its own, the last in order; repeated rows are rounded one by one;
an empty table gives an empty table; columns of other names pass through `sample` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import _tools as tools

#: Fixed values of the mix: weights by turns, share of all words, most copies of a document.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2.0
BUCKET_ROWS, FAN_IN = 20_000, 64


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, target.

    Targets share `share` of all words by weight; what a source cannot use (more than `most`
    times its size) is shared again by weight among the others until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    totals = tools.stage(totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    budget = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, None  # words per unit of weight
    while True:
        is_full = F.col("cap") <= level * F.col("weight")
        capped, open_weight, n = totals.agg(F.sum(F.when(is_full, F.col("cap"))), F.sum(F.when(~is_full, F.col("weight"))), F.count(F.when(is_full, 1))).first()
        if n == full or not open_weight:
            break
        full, level = n, max(0.0, (budget - (capped or 0.0)) / open_weight)
    target = F.least("cap", F.lit(level) * F.col("weight"))
    return totals.select("source", "source_size", F.when(F.lit(bool(open_weight)), target).otherwise(F.col("cap")).alias("target"))


def _pair_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pivotal rounding over rows ordered by (bucket, source): sets part to 0 or 1, or leaves
    the last open row of each (bucket, source)."""
    held = None  # (group, part, size, its row as a list)
    schema = None
    for batch in batches:
        schema = batch.schema
        cols = [c.to_pylist() for c in batch.columns]
        at = {name: i for i, name in enumerate(schema.names)}
        part, size, draw = cols[at["part"]], cols[at["size"]], cols[at["draw"]]
        groups = list(zip(cols[at["bucket"]], cols[at["source"]]))
        out = []
        for i, group in enumerate(groups):
            row = [c[i] for c in cols]
            p, s = part[i], size[i]
            if s <= 0 or p <= 0.0 or p >= 1.0:
                row[at["part"]] = 1.0 if s > 0 and p >= 1.0 else 0.0
                out.append(row)
                continue
            if held is None or held[0] != group:
                if held is not None:
                    out.append(held[3])
                held = (group, p, s, row)
                continue
            _, q, t, other = held
            up, down = min(t * (1 - q), s * p), min(s * (1 - p), t * q)  # words to the held, from it
            if draw[i] * (up + down) < down:
                full, gone = t * (1 - q) <= s * p, s * p <= t * (1 - q)
                q, p = (1.0 if full else q + up / t), (0.0 if gone else p - up / s)
            else:
                full, gone = s * (1 - p) <= t * q, t * q <= s * (1 - p)
                p, q = (1.0 if full else p + down / s), (0.0 if gone else q - down / t)
            row[at["part"]], other[at["part"]] = p, q
            still = [(x, n, r) for x, n, r in ((q, t, other), (p, s, row)) if 0.0 < x < 1.0]
            out += [r for x, _, r in ((q, t, other), (p, s, row)) if not 0.0 < x < 1.0]
            held = (group, *still[0]) if still else None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema.names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held[3], schema)], schema.names)


def _rounded(open_rows: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """All rows with part 0 or 1, by a tree of pairings."""
    buckets, level, done = max(1, -(-n_rows // BUCKET_ROWS)), 0, []
    rows = open_rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(buckets)))
    while True:
        drawn = F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit(seed), F.lit(level)), 11) / float(1 << 53)
        dealt = rows.withColumn("draw", drawn).repartition(buckets, "bucket").sortWithinPartitions("bucket", "source", "draw", "doc_id", "size")
        paired = tools.stage(dealt.mapInArrow(_pair_off, dealt.schema))
        left = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(paired.where(~left))
        rows = paired.where(left)
        if buckets == 1:
            last = rows.withColumn("part", F.when(F.col("draw") < F.col("part"), 1.0).otherwise(0.0))
            break
        buckets, level = -(-buckets // FAN_IN), level + 1
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    for d in done:
        last = last.unionByName(d)
    return last


def copies(sized: DataFrame, seed: int = 17, **mix) -> DataFrame:
    """From doc_id, source, size: these, source_size, target and copies (0 to `most`)."""
    sized = tools.stage(sized.select("doc_id", "source", F.col("size").cast("long").alias("size")))
    aims = tools.broadcast_if_small(tools.stage(targets(sized, **mix)))
    aims = aims.withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(aims, sized.source.eqNullSafe(aims["__source"])).drop("__source")
    whole = F.floor(rate).cast("double")
    rows = rows.withColumn("whole", whole).withColumn("part", rate - whole)
    done = _rounded(rows, sized.count(), seed)
    return done.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("part")).otherwise(0.0).cast("long").alias("copies"))


def word_count(text: str) -> Column:
    return F.size(tools.words(F.col(text))).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **mix) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (words)."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    return copies(sized, seed, **mix).withColumn("taken", F.col("size") * F.col("copies"))


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **mix_by) -> DataFrame:
    """The documents taken, with their columns, __copies and __size renamed copies and size.

    A column of docs that has one of the two names is replaced.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    key = F.sha2(F.to_json(F.struct("doc_id", "source", "size"), {"ignoreNullFields": "false"}), 256)
    # rows of one key are interchangeable and take one of two numbers of copies: how many take the larger says it all
    decided = copies(slim, seed, **mix_by).groupBy(key.alias("__key")).agg(F.max("copies").alias("__most"), F.min("copies").alias("__least"), F.count("*").alias("__rows"), F.sum("copies").alias("__sum"))
    larger = F.when(F.col("__most") == F.col("__least"), F.col("__rows")).otherwise(F.col("__sum") - F.col("__least") * F.col("__rows"))
    decided = decided.where("__most > 0").select(F.col("__key").alias("__decided"), F.col("__most").alias("__most"), "__least", larger.alias("__larger"))
    own = F.struct(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    keyed = docs.withColumn("__size", word_count(text)).withColumn("__key", F.sha2(F.to_json(own, {"ignoreNullFields": "false"}), 256))
    # texts are shuffled once: the window and the join are dealt by the same key
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    joined = keyed.withColumn("__nth", nth).join(decided, F.col("__key") == F.col("__decided"))
    taken = F.when(F.col("__nth") <= F.col("__larger"), F.col("__most")).otherwise(F.col("__least"))
    joined = joined.withColumn("__copies", taken).where("__copies > 0")
    return joined.select(*(c for c in docs.columns if c not in ("copies", "size")), F.col("__size").alias("size"), F.col("__copies").alias("copies"))
