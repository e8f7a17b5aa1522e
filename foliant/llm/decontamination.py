"""Benchmark decontamination by spaced-seed hashing.

A fixed mask lays a span over the tokens and ignores some of its positions, so a substituted token
at an ignored position leaves the hash as it was. Hashes of all benchmark positions are indexed,
hashes of all training positions are joined to them, and around every hit
the item is laid over the document without gaps: a stretch of `stretch` tokens (the whole item if
it is shorter) in which at least `agreement` of the tokens are equal is an overlap.

The masks miss nothing that this rule accepts: MASKS holds for every length of stretch a family of which, wherever the
allowed substitutions lie, one mask fits between them (the tests enumerate all placements).

A benchmark of at most `index_bytes` is indexed and broadcast: one pass over the documents, nothing is shuffled.
A larger one is joined in two passes, whatever its size. Seeds of the documents that a bit table of fixed size
(`filter_bits`) can't rule out meet the benchmark's in a shuffle join; the hits are dealt by document into lots of bounded
size, each lot cuts the stretches of its text that it needs, and these meet their items. Equal texts are one text on the way.

Tokens are lower-cased words without marks. Defined cases: null and empty texts overlap nothing, and so do items without a token; items
of fewer than five tokens overlap only documents that consist of them; equal items, and items whose ids are null or
repeat, are reported each; repeated documents are judged alike; empty tables give empty results (no benchmark: all
documents are clean); other columns pass through `clean` untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from foliant.llm import _tools as tools

#: By tokens of the stretch: masks of which one keeps clear of any fifth of the tokens (rounded down).
MASKS = {
    5: ("111", "1101"),
    6: ("1111", "11011"),
    7: ("11011",),
    8: ("11111", "111011"),
    9: ("111011",),
    10: ("11111", "111011", "11010011"),
    11: ("1101011", "1110011"),
    12: ("11111", "111011"),
    13: ("11101011", "11001111"),
}
SHORTEST, STRETCH, AGREEMENT = min(MASKS), max(MASKS), 0.8
_MARKS = re.compile(r"[^\w\s]+")


@dataclass(frozen=True)
class Overlap:
    #: bytes of benchmark texts up to which their index is broadcast
    index_bytes: int = 4_000_000
    #: beyond that: the bit table over their seeds has 2 ** filter_bits bits
    filter_bits: int = 27
    #: and a document's text travels once for so many of its hits
    lot: int = 4096


def tokens(text: str | None) -> list[str]:
    return _MARKS.sub("", (text or "").lower()).split()


class Hasher:
    """64-bit token hashes, remembered within a bound."""

    def __init__(self, remember: int = 500_000):
        self.known, self.remember = {}, remember

    def __call__(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.remember:
            self.known, new = {}, set(words)
        self.known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def seed_hashes(t: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept tokens of the mask at every position it fits."""
    n = len(t) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i, keep in enumerate(mask if n > 0 else ""):
        if keep == "1":
            out += t[i : i + n]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def laid_over(item: np.ndarray, text: np.ndarray, at: int, need: int) -> tuple[int, int, int] | None:
    """Start, tokens and equal tokens of the overlap of two stretches of one length, the text's being its tokens from `at` on."""
    if len(item) < need:
        return None
    same = item == text
    sums = np.r_[0, np.cumsum(same)]
    good = np.flatnonzero(sums[need:] - sums[:-need] >= math.ceil(AGREEMENT * need))
    if not len(good):
        return None
    covered = np.zeros(len(item) + 1, np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + need, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return int(at + good[0]), int(inside.sum()), int(same[inside].sum())


class Index:
    """Seed hashes of items, sorted, by mask; items too short for a mask by all their tokens."""

    def __init__(self, items: list[tuple[int, str | None]]):
        hasher = Hasher()
        texts = [(i, t) for i, t in ((i, hasher(tokens(t))) for i, t in items) if len(t)]
        self.ids, self.texts = [i for i, _ in texts], [t for _, t in texts]
        self.whole: dict[bytes, list[int]] = {}
        of: dict[str, list[int]] = {}
        for k, t in enumerate(self.texts):
            if len(t) < SHORTEST:
                self.whole.setdefault(t.tobytes(), []).append(k)
            for mask in MASKS.get(min(len(t), STRETCH), ()):
                of.setdefault(mask, []).append(k)
        self.masks = {}
        for mask, own in of.items():
            seeds = [seed_hashes(self.texts[k], mask) for k in own]
            h = np.concatenate(seeds)
            item = np.repeat(np.array(own), [len(x) for x in seeds])
            at = np.concatenate([np.arange(len(x)) for x in seeds])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[(h >> np.uint64(42)).astype(np.int64)] = True
            self.masks[mask] = (h[order], item[order], at[order], seen)

    def hits(self, t: np.ndarray) -> set[tuple[int, int]]:
        """(item, offset of the item's start in the tokens) of all seed hits."""
        found = set()
        for mask, (known, item, at, seen) in self.masks.items():
            h = seed_hashes(t, mask)
            where = np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int64)])
            low, high = np.searchsorted(known, h[where], "left"), np.searchsorted(known, h[where], "right")
            for w, a, b in zip(where[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
                found.update((int(item[i]), w - int(at[i])) for i in range(a, b))
        return found

    def overlaps(self, t: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Per item_id: start, tokens and equal tokens of an item's largest overlap with the document."""
        return {self.ids[k]: span for k, span in self.spans(t).items()}

    def spans(self, t: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """The same by place among the items, whose ids may be null or repeat."""
        best = {k: (0, len(t), len(t)) for k in self.whole.get(t.tobytes(), ())} if len(t) else {}
        for k, start in self.hits(t):
            item = self.texts[k]
            a, b = max(0, -start), min(len(item), len(t) - start)
            now = laid_over(item[a:b], t[start + a : start + b], start + a, min(STRETCH, len(item))) if a < b else None
            if now and (k not in best or (now[2], -now[0], now[1]) > (best[k][2], -best[k][0], best[k][1])):
                best[k] = now
        return best


def _scan(texts: list[str | None], index: Index, hasher: Hasher, at_most: int = 4_000_000) -> Iterator[dict[int, tuple[int, int, int]]]:
    """Overlaps of each text. Texts are hashed together, and only those with a hit one by one."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size <= at_most and i + 1 < len(texts):
            continue
        words = [tokens(x) for x in texts[begin : i + 1]]
        ends = np.cumsum([len(w) for w in words])
        flat = hasher([w for doc in words for w in doc])
        maybe = np.array([len(w) < SHORTEST for w in words])
        for mask, (_, _, _, seen) in index.masks.items():
            h = seed_hashes(flat, mask)
            where = np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int64)])
            maybe[np.searchsorted(ends, where, "right")] = True
        for j, end in enumerate(ends.tolist()):
            yield index.spans(flat[end - len(words[j]) : end]) if maybe[j] else {}
        begin, size = i + 1, 0


# ---- a benchmark beyond one index: joins by seed, by text and by item ---------------------------

_SALT = {mask: np.uint64(xxhash.xxh64_intdigest(mask)) for mask in sorted({m for family in MASKS.values() for m in family})}
_WHOLE = np.uint64(xxhash.xxh64_intdigest("whole"))


def _keys(t: np.ndarray, mask: str) -> np.ndarray:
    return seed_hashes(t, mask) ^ _SALT[mask]


def _whole_key(t: np.ndarray) -> np.ndarray:
    """Key of all tokens of a text that is too short for a mask."""
    return np.array([xxhash.xxh64_intdigest(t.tobytes())], np.uint64) ^ _WHOLE


def _table(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _times(value: pa.Array, n: int) -> pa.Array:
    return value.take(pa.array(np.zeros(n, np.int64)))


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        tokened = [hasher(tokens(text)).tobytes() for text in batch.column("text").to_pylist()]
        yield _table({"item": batch.column("item"), "item_tokens": pa.array(tokened, pa.binary())})


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, held in enumerate(batch.column("item_tokens").to_pylist()):
            t = np.frombuffer(held, np.uint64)
            keys = [_keys(t, mask) for mask in MASKS.get(min(len(t), STRETCH), ())] or ([_whole_key(t)] if len(t) else [])
            for k in keys:
                n = len(k)
                yield _table({"key": pa.array(k.view(np.int64)), "item": _times(batch.column("item").slice(i, 1), n), "n": pa.array(np.full(n, len(t), np.int32)), "at": pa.array(np.arange(n, dtype=np.int32))})


def _bits(seeds: DataFrame, n_bits: int) -> np.ndarray:
    """One bit for every value of the first n_bits bits of a key; 2 ** n_bits bits whatever the number of seeds."""
    slot = F.shiftrightunsigned("key", 64 - n_bits)
    words = seeds.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - n_bits}) & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << (n_bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def _doc_seeds(texts: DataFrame, seeds: DataFrame, n_bits: int) -> DataFrame:
    """Seeds of the texts that the bit table knows: key, digest, at."""
    table = texts.sparkSession.sparkContext.broadcast(_bits(seeds, n_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, shift = Hasher(), np.uint64(64 - n_bits)
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                t = hasher(tokens(text))
                for k in [_keys(t, mask) for mask in _SALT] if len(t) >= SHORTEST else [_whole_key(t)] * bool(len(t)):
                    slot = k >> shift
                    at = np.flatnonzero(table.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                    if len(at):
                        yield _table({"key": pa.array(k[at].view(np.int64)), "digest": _times(batch.column("digest").slice(i, 1), len(at)), "at": pa.array(at.astype(np.int32))})

    return texts.mapInArrow(run, "key long, digest binary, at int")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, the tokens that lie under the items of its hits, as far as these are long enough."""
    hasher = Hasher()
    for batch in batches:
        for i, (text, hits) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())):
            t, rows = hasher(tokens(text)), []
            for h in hits:
                start, n = h["start"], h["n"]
                a, b = max(0, -start), min(n, len(t) - start)
                if b - a >= min(STRETCH, n) and (n >= SHORTEST or n == len(t)):
                    rows.append((h["item"], n, a, start + a, t[start + a : start + b].tobytes()))
            if rows:
                item, n, a, at, cut = zip(*rows)
                kinds = pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()
                made = [pa.array(c, kind) for c, kind in zip((item, n, a, at, cut), kinds)]
                yield _table({"digest": _times(batch.column("digest").slice(i, 1), len(rows)), **dict(zip(("item", "n", "skip", "at", "cut"), made))})


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("n", "skip", "at", "cut", "item_tokens")]
        for i, (n, skip, at, cut, item) in enumerate(zip(*columns)):
            text = np.frombuffer(cut, np.uint64)
            now = laid_over(np.frombuffer(item, np.uint64)[skip : skip + len(text)], text, at, min(STRETCH, n))
            if now:
                rows.append((i, *now))
        if rows:
            i, *spans = zip(*rows)
            own = {c: batch.column(c).take(pa.array(i)) for c in ("digest", "item")}
            yield _table({**own, **dict(zip(("start", "n_tokens", "n_equal"), (pa.array(x, pa.int64()) for x in spans)))})


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def _joined(texts: DataFrame, items: DataFrame, rule: Overlap) -> DataFrame:
    """Overlaps of texts (digest, text) and distinct items (item, text), staged: digest, item, start, n_tokens, n_equal."""
    items = tools.stage(items.mapInArrow(_item_tokens, "item binary, item_tokens binary"))
    seeds = tools.stage(items.mapInArrow(_item_seeds, "key long, item binary, n int, at int"))
    met = _doc_seeds(texts, seeds, rule.filter_bits).withColumnRenamed("at", "doc_at").join(seeds, "key")
    hits = tools.stage(met.select("digest", "item", "n", (F.col("doc_at") - F.col("at")).alias("start")).distinct())
    lots = hits.groupBy("digest").agg(F.ceil(F.count("*") / rule.lot).alias("lots"))
    dealt = hits.join(lots, "digest").withColumn("lot", F.pmod(F.xxhash64("item", "start"), F.col("lots")))
    dealt = dealt.groupBy("digest", "lot").agg(F.collect_list(F.struct("item", "n", "start")).alias("hits"))
    known = tools.broadcast_if_small(hits.select("digest").distinct())
    held = texts.join(known, "digest", "left_semi").dropDuplicates(["digest"])
    cuts = held.join(dealt, "digest").select("digest", "text", "hits").mapInArrow(_stretches, "digest binary, item binary, n int, skip int, at long, cut binary")
    told = cuts.join(items, "item").mapInArrow(_compared, "digest binary, item binary, start long, n_tokens long, n_equal long")
    best = told.groupBy("digest", "item").agg(F.max(F.struct("n_equal", (-F.col("start")).alias("back"), "n_tokens")).alias("b"))
    return tools.stage(best.select("digest", "item", (-F.col("b.back")).alias("start"), "b.n_tokens", "b.n_equal"))


# ---- both ways ---------------------------------------------------------------------------------


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.length("text") > 0)


def _index(items: DataFrame, rule: Overlap) -> Index | None:
    """The index of the items, if their bytes are few enough to be broadcast."""
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > rule.index_bytes:
        return None
    return Index([(r.item_id, r.text) for r in items.collect()])


def _joined_with(docs: DataFrame, text: str, items: DataFrame, rule: Overlap) -> DataFrame:
    distinct = items.select(_digest("text").alias("item"), "text").dropDuplicates(["item"])
    return _joined(docs.where(F.length(text) > 0).select(_digest(text).alias("digest"), F.col(text).alias("text")), distinct, rule)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", rule: Overlap = Overlap()) -> DataFrame:
    """Every document and item that overlap: doc_id, item_id, start, n_tokens, n_equal."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = _items(benchmark, item_id, "text")
    found = _index(items, rule)
    if found is None:
        told = tools.broadcast_if_small(_joined_with(slim, "text", items, rule))
        named = items.select("item_id", _digest("text").alias("item"))
        return slim.select("doc_id", _digest("text").alias("digest")).join(told, "digest").join(named, "item").select("doc_id", "item_id", "start", "n_tokens", "n_equal")
    index = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows = [(i, index.value.ids[k], *span) for i, found in enumerate(_scan(batch.column(1).to_pylist(), index.value, hasher)) for k, span in sorted(found.items())]
            if rows:
                i, item, start, n, equal = zip(*rows)
                arrays = [batch.column(0).take(pa.array(i)), pa.array(item, batch_kind), *(pa.array(x, pa.int64()) for x in (start, n, equal))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "start", "n_tokens", "n_equal"])

    batch_kind = to_arrow_type(items.schema["item_id"].dataType)
    kinds = slim.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, n_tokens long, n_equal long")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", rule: Overlap = Overlap()) -> DataFrame:
    """The documents that overlap no item, with their columns."""
    items = _items(benchmark, item_id, "text")
    found = _index(items, rule)
    if found is None:
        dirty = tools.broadcast_if_small(_joined_with(docs, text, items, rule).select(F.col("digest").alias("__dirty")).distinct())
        return docs.join(dirty, F.unhex(F.sha2(docs[text], 256)) == dirty["__dirty"], "left_anti")
    index, at = docs.sparkSession.sparkContext.broadcast(found), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            yield batch.filter(pa.array([not found for found in _scan(batch.column(at).to_pylist(), index.value, hasher)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
