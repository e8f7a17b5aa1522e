"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision, in each context of the last 0 to `depth` bytes, has a
Krichevsky-Trofimov estimate from its counts, and a node's weighted probability is one half its own
estimate plus one half the product of its children's. Weighing all depths so gives the code length
of a byte. Texts start after `depth` zero bytes and end with one, which is scored too.

The tree holds every context of the training documents, and grows with them; no task or driver holds it:

1. `survey` deals the documents into units of bounded bytes, which it keeps compressed, and counts the distinct strings of depth + 1
   bytes of each, dealt into parts by the two bytes before the last. Strings of held-out documents count zero, so all have a place.
   There are more parts the larger the corpus is (1,024 to 65,536).
2. `totals` merges the counts of a part as its rows stream by, sorted; first those of each group of units, then the groups.
3. Below the contexts of two bytes a tree lies in one part: `Subtree` weighs it there. What the
   contexts of two bytes weigh (at most 65,536 contexts of 255 decisions, in fact those that occur) goes to the driver,
   which weighs the root's levels and broadcasts the mixture that reaches each of them.
4. Each part then knows the log-probability of its strings; units ask for theirs, and their documents add them up. A part's values
   are sent once, and what units ask of it streams by them one unit at a time, so memory holds one part's values and nothing is copied
   for each group of units. The tasks that do so grow in number with the corpus.

The word baseline is exact: words that make up at least 1 / max_words of the training tokens are
broadcast (so at most max_words), and all others meet their counts in a join.

Defined cases: null texts are empty and score their end alone; a null doc_id counts as empty text
for the split; repeated rows count and are scored each; without training documents all nodes are
empty and a bit costs one bit; other columns are not read.
"""

from __future__ import annotations

import io
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import _tools as tools


@dataclass(frozen=True)
class Tree:
    depth: int = 5  # at most 6: a string is a signed number of 64 bits
    unit_bytes: int = 16_500_000
    group_units: int = 128  # units, about, that are merged at once, and for which there are 1,024 parts
    max_words: int = 1 << 20


def slices(texts: pa.Array | list[str | None], at_most: int = 500_000, rows: int = 128) -> Iterator[list[bytes]]:
    """Lower-cased UTF-8 bytes in lists of bounded size (one text at least).

    A column is turned into Python strings a few rows at a time.
    """
    part, size = [], 0
    for i in range(0, len(texts), rows):
        some = texts[i : i + rows]
        for text in some.to_pylist() if isinstance(some, pa.Array) else some:
            part.append(tools.lower_bytes(text))
            size += len(part[-1])
            if size > at_most:
                yield part
                part, size = [], 0
    if part:
        yield part


def laid_out(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after `depth` zeros and before one; the scored places."""
    pad = bytes(depth)
    flat = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes + depth) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat, at


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of depth + 1 bytes (as numbers) and how often they end at a scored place."""
    flat, at = laid_out(texts, depth)
    key = np.zeros(len(flat), np.int64)
    for back in range(depth, -1, -1):
        key[depth:] = key[depth:] << 8 | flat[depth - back : len(flat) - back]
    return np.unique(key[at], return_counts=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def _packed(numbers: np.ndarray, steps: bool = False) -> bytes:
    """Numbers as bytes, all first bytes first, which compresses well; sorted ones by their steps."""
    numbers = np.diff(numbers, prepend=numbers.dtype.type(0)) if steps else np.ascontiguousarray(numbers)
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def _unpacked(packed: bytes, kind: type, steps: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    numbers = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, len(packed) // size).T).view(kind).ravel()
    return np.cumsum(numbers) if steps else numbers


def _part(keys: np.ndarray, bits: int = 10) -> np.ndarray:
    """The part of each string: one of 2 ** bits, by the two bytes before its last."""
    return ((keys >> 8 & 0xFFFF) * 40503 & 0xFFFF) >> (16 - bits)


def _sealed(rows: pa.RecordBatch) -> bytes:
    """A few documents, compressed."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(rows)
    return out.getvalue()


def _dealt(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted strings by part, and their parts in it."""
    part = _part(keys, bits)
    order = np.argsort(part, kind="stable")
    return order, part[order]


#: What `survey` tells: documents (part -1; n learnt from) and strings of a unit in a part.
_SURVEY = pa.schema([("unit", pa.int64()), ("part", pa.int32()), ("docs", pa.binary()), ("n", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])


def _strings(texts: list[bytes], held: list[bool], depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counted strings of texts; those of held-out ones count zero."""
    found = []
    for hold in (False, True):
        if some := [t for t, h in zip(texts, held) if h == hold]:
            keys, n = grams(some, depth)
            found.append((keys, n * (not hold)))
    return found


def _surveyed(batches: Iterator[pa.RecordBatch], tree: Tree, bits: int, pending: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Rows of a task; memory is bounded by merging and by the bytes of a unit (one text at least)."""

    def rows(size: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SURVEY], schema=_SURVEY)

    def unit_rows(unit: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order, part = _dealt(keys, bits)
        keys, n = keys[order], n[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        spans = list(zip(cuts[:-1], cuts[1:]))
        k = len(spans)
        return rows(k, unit=pa.array([unit] * k), part=pa.array(part[cuts[:-1]]), grams=pa.array([_packed(keys[i:j], True) for i, j in spans], pa.binary()), counts=pa.array([_packed(n[i:j]) for i, j in spans], pa.binary()))

    unit, filled, parts, new = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        done = 0
        for texts in slices(batch.column(2)):
            if filled and filled + sum(map(len, texts)) > tree.unit_bytes:
                yield unit_rows(unit, *_summed(parts))
                unit, filled, parts, new = unit + 1, 0, [], 0
            mine = batch.slice(done, len(texts))
            held = mine.column(1).to_pylist()
            told = pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), pa.array(texts, pa.binary())], ["doc_id", "held_out", "text"])
            yield rows(1, unit=pa.array([unit]), part=pa.array([-1]), docs=pa.array([_sealed(told)], pa.binary()), n=pa.array([held.count(False)]))
            found = _strings(texts, held, tree.depth)
            parts += found
            new += sum(len(k) for k, _ in found)
            if new > pending:
                parts, new = [_summed(parts)], 0
            filled, done = filled + sum(len(t) + 1 for t in texts), done + len(texts)
    if parts:
        yield unit_rows(unit, *_summed(parts))


def _worded(batches: Iterator[pa.RecordBatch], held: int = 600_000) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) of a task, which flushes early."""

    def rows(words: Counter) -> Iterator[pa.RecordBatch]:
        found = iter(words.items())
        while some := list(islice(found, 200_000)):
            w, n = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    words = Counter()
    for batch in batches:
        for texts in slices(batch.column(0)):
            for t in texts:
                words.update(t.split())
            if len(words) > held:
                yield from rows(words)
                words = Counter()
    yield from rows(words)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0 by Stirling's series, shifted up by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_SMALL = 1 << 14
_LG_HALF = np.log(np.pi) / 2 + np.r_[0, np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))]
_LG_ONE = np.r_[0, np.cumsum(np.log(np.arange(1, _SMALL)))]


def _log_gamma(n: np.ndarray, add: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1)]
    large = n >= _SMALL
    if large.any():
        out[large] = _lgamma(n[large] + add)
    return out


def _kt(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts of decisions: log KT probability, and the estimate of a next one."""
    log = _log_gamma(zeros, 0.5, _LG_HALF) + _log_gamma(ones, 0.5, _LG_HALF) - _log_gamma(zeros + ones, 1.0, _LG_ONE) - np.log(np.pi)
    return log, (ones + 0.5) / (zeros + ones + 1)


@dataclass
class Level:
    """Decisions (context, place in the byte) of one depth; `up` is the row of the shorter context above."""

    keys: np.ndarray  # context << 8 | place, sorted; places are in heap order, 1..255
    zeros: np.ndarray
    ones: np.ndarray
    up: np.ndarray | None = None
    one: np.ndarray | None = None  # own estimate
    weighted: np.ndarray | None = None  # log weighted probability
    stop: np.ndarray | None = None  # weight of the own estimate

    def weigh(self, below: np.ndarray | None) -> None:
        log, self.one = _kt(self.zeros, self.ones)
        self.weighted = log if below is None else np.logaddexp(log, below) - np.log(2)
        self.stop = np.ones(len(log)) if below is None else np.exp(log - np.log(2) - self.weighted)

    def shorter(self, depth: int) -> Level:
        """The level above this one, which has contexts of `depth` bytes; sets `up`."""
        keys, self.up = np.unique(self.keys & ((1 << 8 * depth) - 1), return_inverse=True)
        return Level(keys, *(np.bincount(self.up, c, len(keys)).astype(np.int64) for c in (self.zeros, self.ones)))


class Subtree:
    """The levels of some strings from contexts of `top` bytes (first) down to whole ones, weighed."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, top: int):
        byte, context = keys & 255, keys >> 8 << 8
        decisions = np.concatenate([context | 1 << i | byte >> (8 - i) for i in range(8)])
        self.bits = np.concatenate([byte >> (7 - i) & 1 for i in range(8)])
        places, self.at = np.unique(decisions, return_inverse=True)
        ones = np.bincount(self.at, np.tile(n, 8) * self.bits, len(places)).astype(np.int64)
        both = np.bincount(self.at, np.tile(n, 8), len(places)).astype(np.int64)
        self.levels = [Level(places, both - ones, ones)]
        self.levels[0].weigh(None)
        for d in range(depth, top, -1):
            low = self.levels[0]
            high = low.shorter(d)
            high.weigh(np.bincount(low.up, low.weighted, len(high.keys)))
            self.levels.insert(0, high)

    def log10(self, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of each string: log10 probability of its last byte after the others. For the decisions of
        the first level, `mixed` is what shorter contexts contribute and `left` the weight they leave."""
        for level in self.levels:
            if level is not self.levels[0]:
                mixed, left = mixed[level.up], left[level.up]
            mixed, left = mixed + left * level.stop * level.one, left * (1 - level.stop)
        p = mixed[self.at]
        return np.log10(np.where(self.bits == 1, p, 1 - p)).reshape(8, -1).sum(0)


def reached(first: Level, top: int) -> tuple[np.ndarray, np.ndarray]:
    """What contexts shorter than `top` contribute to the decisions of the level of `top`, and leave."""
    levels = [first]
    for d in range(top, 0, -1):
        low = levels[0]
        high = low.shorter(d)
        high.weigh(np.bincount(low.up, low.weighted, len(high.keys)))
        levels.insert(0, high)
    mixed, left = np.zeros(len(levels[0].keys)), np.ones(len(levels[0].keys))
    for high, low in zip(levels, levels[1:]):
        mixed, left = (mixed + left * high.stop * high.one)[low.up], (left * (1 - high.stop))[low.up]
    return mixed, left


def _top(depth: int) -> int:
    return min(2, depth)


def survey(docs: DataFrame, tree: Tree, bits: int = 10) -> DataFrame:
    """Staged rows of `_SURVEY` of (doc_id, held_out, text), strings in 2 ** bits parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _surveyed(batches, tree, bits)

    return tools.stage(docs.select("doc_id", "held_out", "text").mapInArrow(run, "unit long, part int, docs binary, n long, grams binary, counts binary"), "zstd")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, group, grams, counts), those of a part and group side by side, as one row each."""
    mine, held, new = None, [], 0

    def out() -> pa.RecordBatch:
        keys, n = _summed(held)
        return pa.RecordBatch.from_arrays([pa.array([mine[0]], pa.int32()), pa.array([_packed(keys, True)], pa.binary()), pa.array([_packed(n)], pa.binary())], ["part", "grams", "counts"])

    for batch in batches:
        for p, group, g, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (p, group) != mine and held:
                yield out()
                held, new = [], 0
            mine = p, group
            held.append((_unpacked(g, np.int64, True), _unpacked(n, np.int64)))
            new += len(held[-1][0])
            if new > 1_000_000 and new > 2 * len(held[0][0]):
                held = [_summed(held)]
                new = 0
    if held:
        yield out()


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int").alias("group")


def totals(told: DataFrame, groups: int = 1) -> DataFrame:
    """Staged (part, grams, counts) of all units, merged by groups of units first."""
    kind = "part int, grams binary, counts binary"
    rows = told.where("part >= 0").select("part", _group(groups), "grams", "counts")
    rows = rows.repartition("part", "group").sortWithinPartitions("part", "group").mapInArrow(_merged, kind)
    rows = rows.select("part", F.lit(0).alias("group"), "grams", "counts")
    return tools.stage(rows.repartition("part").sortWithinPartitions("part").mapInArrow(_merged, kind), "zstd")


def values(strings: DataFrame, tree: Tree) -> DataFrame:
    """Staged (part, grams, log10): log10 probabilities of the counted strings, packed."""
    depth, top = tree.depth, _top(tree.depth)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, n in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist()):
                first = Subtree(_unpacked(g, np.int64, True), _unpacked(n, np.int64), depth, top).levels[0]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (first.keys, first.zeros, first.ones, first.weighted)], ["keys", "zeros", "ones", "weighted"])

    told = strings.mapInArrow(weights, "keys binary, zeros binary, ones binary, weighted binary").toArrow()
    columns = [np.frombuffer(b"".join(told.column(c).to_pylist()), np.float64 if c == "weighted" else np.int64) for c in ("keys", "zeros", "ones", "weighted")]
    order = np.argsort(columns[0])
    first = Level(*(c[order] for c in columns[:3]), weighted=columns[3][order])
    shared = strings.sparkSession.sparkContext.broadcast((first.keys, *reached(first, top)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, mixed, left = shared.value
        for batch in batches:
            for p, g, n in zip(*(c.to_pylist() for c in batch.columns)):
                tree_of = Subtree(_unpacked(g, np.int64, True), _unpacked(n, np.int64), depth, top)
                at = np.searchsorted(keys, tree_of.levels[0].keys)
                log10 = tree_of.log10(mixed[at], left[at]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([g], pa.binary()), pa.array([_packed(log10)], pa.binary())], ["part", "grams", "log10"])

    return tools.stage(strings.mapInArrow(run, "part int, grams binary, log10 binary"), "zstd")


def asked(told: DataFrame, known: DataFrame, groups: int = 1) -> DataFrame:
    """(unit, part, grams, log10) of the strings of each unit: a part's values come first, and what units ask of it streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = log10 = None
        for batch in batches:
            units, parts, strings, found = [], [], [], []
            for p, unit, g, v in zip(*(c.to_pylist() for c in batch.columns)):
                if unit < 0:
                    keys, log10 = _unpacked(g, np.int64, True), _unpacked(v, np.float32)
                else:
                    units.append(unit)
                    parts.append(p)
                    strings.append(g)
                    found.append(_packed(log10[np.searchsorted(keys, _unpacked(g, np.int64, True))]))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(parts, pa.int32()), pa.array(strings, pa.binary()), pa.array(found, pa.binary())], ["unit", "part", "grams", "log10"])

    asks = told.where("part >= 0").select("part", "unit", "grams", F.lit(None).cast("binary").alias("log10"))
    both = known.select("part", F.lit(-1).cast("long").alias("unit"), "grams", "log10").union(asks)
    dealt = both.repartition("part") if groups == 1 else both.repartition(groups * int(told.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return dealt.sortWithinPartitions("part", "unit").mapInArrow(run, "unit long, part int, grams binary, log10 binary")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Of each unit: its strings, sorted, and their values; its documents."""
    unit, strings, found, sealed = None, [], [], []

    def out() -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        keys = np.concatenate([_unpacked(g, np.int64, True) for g in strings])
        order = np.argsort(keys)
        return keys[order], np.concatenate([_unpacked(v, np.float32) for v in found])[order], sealed

    for batch in batches:
        for u, p, g, v, x in zip(*(c.to_pylist() for c in batch.columns)):
            if u != unit:
                if sealed:
                    yield out()
                unit, strings, found, sealed = u, [], [], []
            if p < 0:
                sealed.append(x)
            else:
                strings.append(g)
                found.append(v)
    if sealed:
        yield out()


def text_scores(texts: list[bytes], depth: int, keys: np.ndarray, log10: np.ndarray) -> np.ndarray:
    """log10 probability of each text and its end, by the values of their strings."""
    flat, at = laid_out(texts, depth)
    key = np.zeros(len(flat), np.int64)
    for back in range(depth, -1, -1):
        key[depth:] = key[depth:] << 8 | flat[depth - back : len(flat) - back]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return np.add.reduceat(log10[np.searchsorted(keys, key[at])].astype(np.float64), np.cumsum(sizes) - sizes)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out=None, tree: Tree = Tree()) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    held_out is a boolean column (from F) of the rows not to learn from; none by default.
    """
    hold = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    d = docs.select(F.col(doc_id).alias("doc_id"), hold.alias("held_out"), F.col(text).alias("text"))
    size = d.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    groups = max(1, -(-size // (tree.unit_bytes * tree.group_units)))
    told = survey(d, tree, min(16, 10 + (groups - 1).bit_length()))
    words = tools.stage(d.where("not held_out").select("text").mapInArrow(_worded, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "zstd")
    n_docs = told.where("part < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, distinct = words.agg(F.sum("n"), F.count("*")).first()
    n_train, n_distinct = (n or 0) + n_docs, distinct + (n_docs > 0)
    over = float(n_train + n_distinct + 1)
    common = words.where(F.col("n") * tree.max_words >= n_train).collect()
    shared = docs.sparkSession.sparkContext.broadcast({bytes(r.word): math.log10((r.n + 1) / over) for r in common})
    depth = tree.depth
    found = asked(told, values(totals(told, groups), tree), groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        end = np.log10((n_docs + 1) / over)
        worth = shared.value
        for keys, log10, sealed in _units(batches):
            for few in sealed:
                docs_of = pa.ipc.open_stream(few).read_next_batch()
                texts = docs_of.column(2).to_pylist()
                rare, times, sums, n_tokens, n_known = [], [], [], [], []
                for t in texts:
                    own = t.split()
                    each = list(map(worth.get, own))
                    missing = [w for w, v in zip(own, each) if v is None]
                    distinct = Counter(missing)
                    rare.append(list(distinct))
                    times.append(list(distinct.values()))
                    sums.append(sum(v for v in each if v is not None) + end)
                    n_tokens.append(len(own) + 1)
                    n_known.append(len(own) - len(missing) + (n_docs > 0))
                scores = text_scores(texts, depth, keys, log10)
                size = np.array([len(t) + 1 for t in texts])
                arrays = [pa.array(np.arange(at, at + len(texts))), docs_of.column(0), docs_of.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores, pa.float64()), pa.array(-scores / np.log10(2) / size), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bits_per_byte", "rare", "times"])
                at += len(texts)

    kind = d.schema["doc_id"].dataType.simpleString()
    rows = found.withColumn("docs", F.lit(None).cast("binary")).union(told.where("part < 0").select("unit", "part", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "docs")).repartition("unit").sortWithinPartitions("unit")
    scored = tools.stage(rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, bits_per_byte double, rare array<binary>, times array<long>"), "zstd")
    met = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k")).join(words, "word", "left")
    each = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(over))
    rest = met.groupBy("row").agg(F.sum(F.col("k") * each).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("found"))
    joined = scored.drop("rare", "times").join(rest, "row", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte")
