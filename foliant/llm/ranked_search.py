"""Ranked lexical search over a clustered index that recursive graph bisection orders.

*Order.* Documents and the indexed terms form a bipartite graph. On a bounded sample of documents the graph is cut in
two, so that the gaps in posting lists cost little when each side is numbered by itself (documents swap sides
while that lowers the cost), then each side again. The cuts are kept as a tree: at every cut a term has a weight that tells to
which side it draws a document. Every document of the corpus, sampled or not, goes down the tree to a leaf.

*Index.* A leaf's documents lie in shards of about `shard_docs`; a leaf that is larger is dealt over several by a hash, so no
shard holds a hot leaf. A shard is one row: its documents, their postings, and for each term the highest part that it adds to any score there.

*Search.* A shard's highest parts times the weights of a query's terms bound what any document in it can
score. Each query visits its shards from the highest bound on, in rounds of growing size, keeps its best documents, and stops when
no shard left has a bound that reaches the last of them: results are exact, ties included, whatever the clusters are like. Places
in the index are mapped back to ids, which order equal scores.

The index holds the terms that the queries ask for; queries are dealt into blocks of at most `block_terms`
terms, each a pass. What reaches the driver: a block's terms with their frequencies, the sample (`Sample`), and the leaves' sizes.

Cases: a null or empty text has no term and is never found, but a document without indexed terms still counts; a query without terms, or null, has no
results. Repeated rows are documents (or queries) of their own; null ids come last among equal scores. No documents, or no queries: no results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import _tools as tools

#: What a byte becomes: A-Z are lowered, letters, digits and all bytes from 128 on stay, the rest separates terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LONG_MAX = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Scoring:
    """score = sum of w * ((10^9 tf) div (1000 tf + 8 m)); m = 100 - b + ((b n N) div L) with b a percentage."""

    length_percent: int = 90

    def weight(self, n_docs: int, df: int) -> int:
        return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))

    def parts(self, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
        m = 100 - self.length_percent + (self.length_percent * n * n_docs) // n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Sample:
    """What the bisection is fitted on: about this many documents (twice as many at most), by hash, with at most so many terms each."""

    docs: int = 4096
    terms: int = 256
    rounds: int = 12
    depth: int = 6


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


# ---- the bisection -------------------------------------------------------------------------


def _gaps(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits for the gaps of a term's postings: its degree on a side of that size."""
    return degree * np.log2(np.maximum(size, 1) / (degree + 1.0))


def bisection(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, sample: Sample) -> np.ndarray:
    """weights[node, term] of the cuts, nodes as in a heap from 1 on; a document goes right where its weights sum above 0.

    (doc, term) are the edges of the sampled graph.
    """
    weights = np.zeros((1 << sample.depth, n_terms), np.float32)
    part = np.ones(n_docs, np.int64)  # the node that each document is in
    edges = np.argsort(doc, kind="stable")
    doc, term = doc[edges], term[edges]
    for level in range(sample.depth):
        low = 1 << level
        # halves by place in the order so far
        place = np.argsort(part, kind="stable")
        size = np.bincount(part - low, minlength=low)
        rank = np.empty(n_docs, np.int64)
        rank[place] = np.arange(n_docs) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        side = (rank >= (size[part - low] + 1) // 2).astype(np.int64)
        for _ in range(sample.rounds):
            degree = np.zeros((low, 2, n_terms))
            np.add.at(degree, (part[doc] - low, side[doc], term), 1)
            sizes = np.zeros((low, 2))
            np.add.at(sizes, (part - low, side), 1)
            here = degree[part[doc] - low, side[doc], term]
            there = degree[part[doc] - low, 1 - side[doc], term]
            n_here, n_there = sizes[part[doc] - low, side[doc]], sizes[part[doc] - low, 1 - side[doc]]
            saved = _gaps(here, n_here) + _gaps(there, n_there) - _gaps(here - 1, n_here) - _gaps(there + 1, n_there)
            gain = np.bincount(doc, saved, minlength=n_docs)
            swaps = 0
            for node in range(low):  # the best of either side change places while both together gain
                mine = np.flatnonzero(part == node + low)
                left, right = (mine[side[mine] == s] for s in (0, 1))
                left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
                n = min(len(left), len(right))
                good = int(np.count_nonzero(gain[left[:n]] + gain[right[:n]] > 1e-9))  # sums fall along both orders
                side[left[:good]], side[right[:good]] = 1, 0
                swaps += good
            if not swaps:
                break
        degree = np.zeros((low, 2, n_terms))
        np.add.at(degree, (part[doc] - low, side[doc], term), 1)
        sizes = np.zeros((low, 2))
        np.add.at(sizes, (part - low, side), 1)
        more = _gaps(degree + 1, sizes[:, :, None]) - _gaps(degree, sizes[:, :, None])
        weights[low : 2 * low] = more[:, 0] - more[:, 1]
        part = 2 * part + side
    return weights


def leaf_of(terms: np.ndarray, weights: np.ndarray, depth: int) -> int:
    node = 1
    for _ in range(depth):
        node = 2 * node + int(weights[node, terms].sum() > 0)
    return node - (1 << depth)


# ---- the index -----------------------------------------------------------------------------

_ENTRY = "doc_id long, n long, terms array<int>, tfs array<int>"


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)))


def entries(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all its terms), and the indexed terms with their frequencies, of every document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, tfs, kept = batch.column(0), [], [], [], []
            for i, raw in enumerate(batch.column(1).cast(pa.binary())):
                said = terms_of(raw.as_py() or b"")
                if not said:
                    continue
                found = sorted((vocabulary[t], c) for t, c in Counter(said).items() if t in vocabulary)
                kept.append(i)
                sizes.append(len(said))
                pairs = np.array(found, np.int32).reshape(-1, 2)
                terms.append(pairs[:, 0])
                tfs.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), _lists(terms), _lists(tfs)], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _ENTRY)


def fitted(indexed: DataFrame, n_docs: int, n_terms: int, depth: int, sample: Sample) -> np.ndarray:
    """The tree's weights from a bounded sample: at most 2 * sample.docs * sample.terms numbers reach the driver."""
    share = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, sample.docs / n_docs) * (1 << 30)))
    d = indexed.where((F.size("terms") > 0) & share)
    some = F.transform(F.slice(F.array_sort(F.transform("terms", lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), 1, sample.terms), lambda x: x["t"])
    rows = d.select(some.alias("t")).limit(2 * sample.docs).collect()
    doc = np.repeat(np.arange(len(rows)), [len(r.t) for r in rows])
    term = np.array([t for r in rows for t in r.t], np.int64)
    return bisection(doc, term, len(rows), n_terms, Sample(sample.docs, sample.terms, sample.rounds, depth))


_PLACED = f"leaf int, {_ENTRY}"


def placed(indexed: DataFrame, weights: np.ndarray, depth: int) -> DataFrame:
    """Entries with their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            leaves = [leaf_of(flat[a:b], weights, depth) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), *batch.columns], ["leaf", *batch.schema.names])

    return indexed.mapInArrow(run, _PLACED)


_SHARD = "shard int, ids binary, named binary, terms binary, ends binary, places binary, parts binary, peaks binary"


def shards(dealt: DataFrame, n_docs: int, n_terms: int, scoring: Scoring) -> DataFrame:
    """One row a shard: document ids; and by term its documents, the parts that it adds to their scores, and the highest of these."""

    def run(rows: pa.Table) -> pa.Table:
        ids, lists = rows.column("doc_id").combine_chunks(), rows.column("terms").combine_chunks()
        counts = np.array([len(x) for x in lists], np.int64)
        term, tf = lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        place, n = np.repeat(np.arange(len(counts)), counts), np.repeat(rows.column("n").to_numpy(), counts)
        parts = scoring.parts(tf, n, n_docs, n_terms)
        order = np.argsort(term, kind="stable")
        term, place, parts = term[order], place[order].astype(np.int32), parts[order]
        firsts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        peaks = np.maximum.reduceat(parts, firsts) if len(term) else parts
        values = [ids.fill_null(_LONG_MAX).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), term[firsts].astype(np.int32), np.append(firsts, len(term)).astype(np.int64), place, parts, peaks]
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), **{c.split()[0]: pa.array([v.tobytes()], pa.binary()) for c, v in zip(_SHARD.split(", ")[1:], values)}})

    return dealt.groupBy("shard").applyInArrow(run, _SHARD)


# ---- the search ----------------------------------------------------------------------------


class Queries:
    """The queries of a block: which terms each has, and which queries each term is in."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray):
        self.weights, self.n = weights, len(terms)
        by_term: dict[int, list[int]] = {}
        for q, ts in enumerate(terms):
            for t in ts:
                by_term.setdefault(t, []).append(q)
        self.of_term = {t: np.array(qs, np.int64) for t, qs in by_term.items()}

    def bounds(self, terms: np.ndarray, peaks: np.ndarray) -> np.ndarray:
        """The most that each query can score in a shard."""
        out = np.zeros(self.n, np.int64)
        for t, peak in zip(terms.tolist(), peaks.tolist()):
            out[self.of_term[t]] += int(self.weights[t]) * peak
        return out

    def scores(self, asked: np.ndarray, n_docs: int, terms: np.ndarray, ends: np.ndarray, places: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """scores[document, query] in a shard, of the queries asked."""
        column = np.full(self.n, -1, np.int64)
        column[asked] = np.arange(len(asked))
        out = np.zeros((n_docs, len(asked)), np.int64)
        for t, a, b in zip(terms.tolist(), ends.tolist(), ends[1:].tolist()):
            cs = column[self.of_term[t]]
            cs = cs[cs >= 0]
            if len(cs):
                out[np.ix_(places[a:b], cs)] += (self.weights[t] * parts[a:b])[:, None]
        return out


def _bounds(index: DataFrame, queries: Queries) -> DataFrame:
    """q, shard, bound of every shard in which a query can score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bound = queries.bounds(np.frombuffer(batch.column(1)[i].as_py(), np.int32), np.frombuffer(batch.column(2)[i].as_py(), np.int64))
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), batch.column(0)[i].as_py(), np.int32)), pa.array(bound[some])], ["q", "shard", "bound"])

    return index.select("shard", "terms", "peaks").mapInArrow(run, "q int, shard int, bound long")


_HIT = "q int, doc_id long, score long"


def _visited(index: DataFrame, visits: DataFrame, queries: Queries, top: int, max_broadcast: int) -> DataFrame:
    """The best documents of each visited shard for each query that visits it."""
    asked = visits.groupBy("shard").agg(F.collect_list("q").alias("asked"))  # at most the queries of a block
    met = index.join(tools.broadcast_if_small(asked, max_broadcast), "shard").select("ids", "named", "terms", "ends", "places", "parts", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, named, terms, ends, places, parts = (np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in enumerate((np.int64, bool, np.int32, np.int64, np.int32, np.int64)))
                own = np.array(batch.column(6)[i].as_py(), np.int64)
                scores = queries.scores(own, len(ids), terms, ends, places, parts)
                q, doc, said = [], [], []
                for c in range(len(own)):
                    column = scores[:, c]
                    some = np.flatnonzero(column)
                    best = some[np.lexsort((ids[some], ~named[some], -column[some]))[:top]]
                    q.append(np.full(len(best), own[c], np.int32)), doc.append(best), said.append(column[best])
                at = np.concatenate(doc) if doc else np.zeros(0, np.int64)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(ids[at], mask=~named[at]), pa.array(np.concatenate(said))], ["q", "doc_id", "score"])

    return met.mapInArrow(run, _HIT)


def _best(hits: DataFrame, top: int) -> DataFrame:
    """The `top` best hits of each query; Spark cuts each task's rows at that rank before they are shuffled."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", scoring: Scoring = Scoring(), sample: Sample = Sample(), shard_docs: int = 1024, first_visits: int = 4, block_terms: int = 16_384, max_broadcast: int = 32 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score, shards (how many the item had to visit) of the best documents of each item."""
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long, shards long"
    out = spark.createDataFrame([], schema)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    for block in _blocks(asked, block_terms):
        out = out.unionByName(_searched(docs, block, top, doc_id, text, scoring, sample, shard_docs, first_visits, max_broadcast))
    return out


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Queries with their distinct terms, as many at a time as have so many terms; only one block is held."""
    held, n = [], set()
    for r in items.toLocalIterator():
        terms = sorted(set(terms_of((r.text or "").encode("utf-8", "surrogatepass"))))
        if not terms:
            continue
        if held and len(n | set(terms)) > block_terms:
            yield held
            held, n = [], set()
        held.append((r.item_id, terms))
        n |= set(terms)
    if held:
        yield held


def _searched(docs: DataFrame, block: list[tuple[int, list[bytes]]], top: int, doc_id: str, text: str, scoring: Scoring, sample: Sample, shard_docs: int, first_visits: int, max_broadcast: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
    indexed = tools.stage(entries(docs, doc_id, text, vocabulary))
    total = indexed.agg(F.count("*"), F.sum("n")).first()
    n_docs, n_terms = total[0], total[1] or 0
    if not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, shards long")
    frequency = {r.t: r.n for r in indexed.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a block's terms
    weights = np.array([scoring.weight(n_docs, frequency.get(i, 0)) for i in range(len(vocabulary))], np.int64)

    depth = max(0, min(sample.depth, math.ceil(math.log2(max(1, n_docs / shard_docs)))))
    tree = fitted(indexed, n_docs, len(vocabulary), depth, sample)
    told = tools.stage(placed(indexed, tree, depth))
    sizes = {r.leaf: r.n for r in told.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # 2 ** depth rows at most
    start, first = {}, 0
    for leaf in sorted(sizes):
        start[leaf], first = first, first + math.ceil(sizes[leaf] / shard_docs)
    plan = spark.createDataFrame([(leaf, start[leaf], math.ceil(n / shard_docs)) for leaf, n in sizes.items()], "leaf int, start int, parts int")
    spread = F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.col("parts"))
    dealt = told.where(F.size("terms") > 0).join(F.broadcast(plan), "leaf").withColumn("shard", (F.col("start") + spread).cast("int")).select("shard", "doc_id", "n", "terms", "tfs")
    index = tools.stage(shards(dealt, n_docs, n_terms, scoring))

    queries = Queries([[vocabulary[t] for t in ts] for _, ts in block], weights)
    left = tools.stage(_bounds(index, queries))
    best = spark.createDataFrame([], _HIT + ", rank int")
    went = spark.createDataFrame([], "q int, shards long")
    visits = first_visits
    while True:
        # a query's last place, once all places are taken: shards that can't reach it are done with
        last = best.groupBy("q").agg(F.max("rank").alias("filled"), F.min("score").alias("least"))
        reach = F.when(F.col("filled") >= top, F.col("least")).otherwise(F.lit(1).cast("long"))
        ahead = left.join(F.broadcast(last), "q", "left").where(F.col("bound") >= F.coalesce(reach, F.lit(1).cast("long"))).select(*left.columns)
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "shard")
        now = tools.stage(ahead.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= visits).select(*left.columns))
        if now.isEmpty():
            break
        hits = _visited(index, now, queries, top, max_broadcast)
        best = tools.stage(_best(best.drop("rank").unionByName(hits), top))
        went = tools.stage(went.unionByName(now.groupBy("q").agg(F.count("*").alias("shards"))).groupBy("q").agg(F.sum("shards").alias("shards")))
        left = tools.stage(ahead.join(now.select("q", "shard"), ["q", "shard"], "left_anti"))
        visits *= 4
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "q int, item_id long")  # one block
    return best.join(F.broadcast(names), "q").join(F.broadcast(went), "q").select("item_id", "rank", "doc_id", "score", "shards")
