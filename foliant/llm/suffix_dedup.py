"""Removal of byte strings that recur anywhere, by a distributed merge sort of suffixes.

Sorting every suffix of a corpus would move each byte `length` times, so only suffixes at anchors are
sorted. An anchor is the least hash among the seeds (short substrings) of some window of
`length` bytes; equal windows have equal anchors at equal places, so a repeat of `length` bytes is always
seen at an anchor, and anchors whose seed is unique in the corpus are left out.

The suffixes at the others, followed by what precedes them, are sorted in each task, front-coded
(shared prefix length and the rest) and exchanged as runs by seed. A loser tree merges the runs
of a seed; it knows every string's common prefix with the last one out, so no known prefix is
compared again, and hands out the common prefix of neighbours with the order. From these and
the same on the left side follows how far each anchor's neighbourhood recurs.

A seed with very many neighbourhoods is split: a window around it reaches so far to the right that its strings agree on
`half` bytes behind the seed, or so far to the left that they agree on as many before it. So each of its strings
goes to two places, by what follows the seed and by what precedes it, and of what is found in either the farther reach counts.

Beside the bytes, passages of `passage_words` words that occur in several documents are counted, since such a
passage may have fewer than `length` bytes. It is found the same way: the least hash among the short word
sequences of a window of words is its anchor, and windows whose anchor recurs are compared by their hash.

Copies are never expanded: equal texts are one text with a count, and anchors with equal
neighbourhoods one class with a count. Results go back to texts and rows by joins that Spark may split.

Defined cases: null and empty texts lose nothing; texts shorter than `length` lose nothing; a text that
several rows hold loses everything (if it is long enough); runs of one repeated byte lose all
bytes within a repeat; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import _tools as tools

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_HEAD = struct.Struct("<HHHqq")  # shared prefix, bytes that follow, suffix bytes of the string, class


@dataclass(frozen=True)
class Repeat:
    length: int = 400
    seed: int = 64
    piece: int = 300_000  # bytes hashed together; any size finds the same
    part_rows: int = 20_000  # anchors to a part of the exchange
    hot_seeds: int = 256  # most seeds to broadcast
    wide_seed: int = 5_000  # places of a seed from which on it is split
    passage_words: int = 51
    passage_seed: int = 10  # words

    @property
    def half(self) -> int:
        return (self.length - self.seed) // 2


_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)], dtype=np.uint64) for p in (np.uint64(_P), np.uint64(_P_INVERSE))]
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _rolling(flat: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hash of the k bytes at every place."""
    n = len(flat)
    powers, inverse = _power(n)
    x = flat.astype(np.uint64)
    x += np.uint64(1)
    x *= powers[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    h = np.subtract(sums[k:], sums[: n - k + 1], out=x[: n - k + 1])
    h *= inverse[: n - k + 1]
    return _mix(h)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w values in a row, by block prefixes and suffixes."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], rule: Repeat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, seed hash) of the anchors of texts laid end to end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    if len(flat) < rule.length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = _rolling(flat, rule.seed)
    ranked = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)  # ties: leftmost
    least = _sliding_least(ranked, rule.length - rule.seed + 1)
    ends = np.cumsum(sizes)
    inside = np.repeat(ends, sizes)[: len(least)] - np.arange(len(least)) >= rule.length
    at = (least[inside] & np.uint64(0xFFFFFF)).astype(np.int64)
    at = np.unique(at)
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends - sizes)[text], h[at].view(np.int64)


def passages(texts: list[bytes], rule: Repeat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of words: text, first word, word of its anchor, the anchor's seed hash, the window's hash.

    White space between words makes no difference.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(flat) < 2 * rule.passage_words - 1:
        return none, none, none, none, none
    ends = np.cumsum(sizes)
    ink = (flat != 32) & ((flat < 9) | (flat > 13))
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    first = (ends - sizes)[sizes > 0]
    start[first] = ink[first]
    at = np.flatnonzero(start)
    if len(at) < rule.passage_words:
        return none, none, none, none, none
    x = flat[ink].astype(np.uint64) + np.uint64(1)
    bounds = np.r_[np.flatnonzero(start[ink]), len(x)]
    x[bounds[:-1]] += np.uint64(256)
    powers, inverse = _power(len(x) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(x * powers[: len(x)], dtype=np.uint64)]

    def of(k: int) -> np.ndarray:
        """Hash of the k words from every word on."""
        return _mix((sums[bounds[k:]] - sums[bounds[:-k]]) * inverse[bounds[:-k]])

    h, whole = of(rule.passage_seed), of(rule.passage_words)
    ranked = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    least = (_sliding_least(ranked, rule.passage_words - rule.passage_seed + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, at, "right")
    inside = np.flatnonzero(text[: len(least)] == text[rule.passage_words - 1 :])
    origin = np.searchsorted(text, np.arange(len(texts)))[text[inside]]
    anchor = least[inside]
    return text[inside], inside - origin, anchor - origin, h[anchor].view(np.int64), whole[inside].view(np.int64)


def _word_pieces(texts: list[bytes], rule: Repeat) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, words before, bytes) of bounded size; pieces of a text overlap by a window less a word."""
    part, size, step = [], 0, max(1, rule.piece // 8)
    for i, t in enumerate(texts):
        if len(t) <= rule.piece:
            own = [(0, t)]
        else:
            words = t.split()
            own = [(k, b" ".join(words[k : k + step + rule.passage_words - 1])) for k in range(0, len(words), step)]
        for offset, piece in own:
            part.append((i, offset, piece))
            size += len(piece)
            if size >= rule.piece:
                yield part
                part, size = [], 0
    if part:
        yield part


def _few_rows(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that few rows at a time become Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _pieces(texts: list[bytes], rule: Repeat) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, bytes) of bounded size; pieces of a text overlap by length - 1."""
    part, size = [], 0
    for i, t in enumerate(texts):
        for offset in range(0, max(1, len(t) - rule.length + 1), rule.piece):
            if len(t) >= rule.length:
                part.append((i, offset, t[offset : offset + rule.piece + rule.length - 1]))
                size += len(part[-1][2])
            if size >= rule.piece:
                yield part
                part, size = [], 0
    if part:
        yield part


# ---- runs and their merge ------------------------------------------------------------------


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least start."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    while n - start > 8:
        mid = (start + n) // 2
        if a[start:mid] == b[start:mid]:
            start = mid
        else:
            n = mid
    while a[start] == b[start]:
        start += 1
    return start


def front_coded(strings: list[tuple[bytes, int, int, int]]) -> bytes:
    """A run of sorted (string, suffix bytes, class, class) records."""
    out, last = [], b""
    for s, right, c1, c2 in strings:
        shared = common(last, s)
        out += [_HEAD.pack(shared, len(s) - shared, right, c1, c2), s[shared:]]
        last = s
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[bytes, int, tuple[int, int, int]]]:
    """(string, common prefix with the one before, record) of a run."""
    at, last = 0, b""
    while at < len(run):
        shared, more, right, c1, c2 = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        last = last[:shared] + run[at : at + more]
        at += more
        yield last, shared, (right, c1, c2)


def merged(runs: list[bytes]) -> Iterator[tuple[bytes, int, tuple[int, int, int]]]:
    """The strings of sorted runs in order, with the common prefix with the one before.

    A tournament tree of losers: each holds its common prefix with the last winner that passed
    it. The longer one is the smaller string; only at a tie are bytes compared, from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    feeds = [decoded(r) for r in runs] + [iter(())] * (k - len(runs))
    heads = [next(f, None) for f in feeds]
    known = [0] * k  # common prefix of the run's head with the last string out
    losers = [-1] * k

    def beats(i: int, j: int) -> bool:
        """Whether head i comes before head j; sets the loser's common prefix to the winner's."""
        if heads[i] is None or heads[j] is None:
            return heads[j] is None
        if known[i] != known[j]:
            return known[i] > known[j]
        a, b = heads[i][0], heads[j][0]
        n = common(a, b, known[i])
        first = n == len(a) or (n < len(b) and a[n] < b[n])
        known[j if first else i] = n
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        i, j = play(2 * node), play(2 * node + 1)
        win, lose = (i, j) if beats(i, j) else (j, i)
        losers[node] = lose
        return win

    winner = play(1) if k > 1 else 0
    while heads[winner] is not None:
        string, _, record = heads[winner]
        yield string, known[winner], record
        heads[winner] = next(feeds[winner], None)
        if heads[winner] is not None:
            known[winner] = heads[winner][1]
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


# ---- how far neighbourhoods recur ----------------------------------------------------------


def _reach_pairs(rights: list[int], shared: list[int], lefts: list[bytes], rule: Repeat) -> tuple[list[int], list[int]]:
    """Left and right reach of each string of a group by comparing pairs (small groups)."""
    g = len(rights)
    left, right = [0] * g, [0] * g
    for i in range(g):
        through = rule.length
        for j in range(i + 1, g):
            through = min(through, shared[j])
            r = min(through, rights[i], rights[j])
            n = common(lefts[i], lefts[j]) if lefts[i] and lefts[j] else 0
            if n + r >= rule.length:
                for x in (i, j):
                    left[x], right[x] = max(left[x], n), max(right[x], r)
    return left, right


def _reach_offsets(rights: list[int], shared: list[int], lefts: list[bytes], rule: Repeat) -> tuple[list[int], list[int]]:
    """The same for large groups: at each split of the window, ranks of both sides that agree."""
    g = len(rights)
    order = sorted(range(g), key=lefts.__getitem__)
    near = np.array([0] + [common(lefts[a], lefts[b]) for a, b in zip(order, order[1:])])
    order, rights, shared = np.array(order), np.array(rights), np.array(shared)
    sizes = np.array([len(x) for x in lefts])
    left, right, rank = np.zeros(g, np.int64), np.zeros(g, np.int64), np.empty(g, np.int64)
    for o in range(rule.length - rule.seed + 1):
        fits = (sizes >= o) & (rights >= rule.length - o)
        if fits.sum() < 2:
            continue
        rank[order] = np.cumsum(near < o)
        key = (np.cumsum(shared < rule.length - o) * g + rank)[fits]
        _, of, n = np.unique(key, return_inverse=True, return_counts=True)
        again = np.flatnonzero(fits)[n[of] > 1]
        left[again] = o
        right[again] = np.maximum(right[again], rule.length - o)
    return left.tolist(), right.tolist()


def reaches(runs: list[bytes], rule: Repeat) -> Iterator[tuple[int, int, int, int]]:
    """(class, class, left, right) of the classes that share a window with another class."""
    group: list[tuple[int, int, bytes, int, int]] = []
    last = None

    def solved() -> Iterator[tuple[int, int, int, int]]:
        if len(group) > 1:
            rights, shared, lefts, c1, c2 = map(list, zip(*group))
            reach = _reach_pairs if len(group) <= 40 else _reach_offsets
            for a, b, left, right in zip(c1, c2, *reach(rights, shared, lefts, rule)):
                if right:
                    yield a, b, left, right

    for s, n, (right, c1, c2) in merged(runs):
        if last == (right, c1, c2):
            continue  # the same class from another run
        if n < rule.seed:
            yield from solved()
            group = []
        group.append((right, n, s[right:], c1, c2))
        last = (right, c1, c2)
    yield from solved()


def _neighbourhoods(batches: Iterator[pa.RecordBatch], rule: Repeat, parts: int, flush: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """From (t1, t2, text, places, wide ones among them): member rows (t1, t2, place, c1, c2) and run rows (part, run)."""
    names = ["t1", "t2", "place", "c1", "c2", "part", "run"]
    seen: set[tuple[int, int]] = set()
    held: dict[int, list] = {}
    size = 0

    def runs() -> Iterator[pa.RecordBatch]:
        done, made, n = [], [], 0
        for p, strings in sorted(held.items()):
            strings.sort()
            done.append(p)
            made.append(front_coded(strings))
            n += len(made[-1])
            if n > 8_000_000:
                yield row_of(done, made)
                done, made, n = [], [], 0
        if done:
            yield row_of(done, made)

    def row_of(done: list, made: list) -> pa.RecordBatch:
        blank = pa.nulls(len(done), pa.int64())
        return pa.RecordBatch.from_arrays([blank] * 5 + [pa.array(done, pa.int64()), pa.array(made, pa.binary())], names)

    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
            places = batch.column(3)[i].as_py()
            wide = set(batch.column(4)[i].as_py())
            classes = []
            for at in places:
                right, left = text[at : at + rule.length], text[max(0, at - rule.length + rule.seed) : at][::-1]
                s = right + left
                c1, c2 = struct.unpack("<qq", xxhash.xxh3_128_digest(s, seed=len(right)))
                classes.append((c1, c2))
                if (c1, c2) not in seen:
                    seen.add((c1, c2))
                    seed = xxhash.xxh64_intdigest(right[: rule.seed])
                    sides = [(right[: rule.seed + rule.half], 1), (left[: rule.half], 2)] if at in wide else []
                    for p in {xxhash.xxh64_intdigest(x, seed=seed ^ side) % parts for x, side in sides} or {seed % parts}:
                        held.setdefault(p, []).append((s, len(right), c1, c2))
                        size += len(s) + 100
            t1, t2 = (pa.array([batch.column(c)[i].as_py()] * len(places), pa.int64()) for c in (0, 1))
            c1, c2 = zip(*classes)
            blank = [pa.nulls(len(places), pa.int64()), pa.nulls(len(places), pa.binary())]
            yield pa.RecordBatch.from_arrays([t1, t2, pa.array(places, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), *blank], names)
            if size > flush:
                yield from runs()
                seen, held, size = set(), {}, 0
    yield from runs()


def _cut(text: str, spans: list, rule: Repeat) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, bytes kept) for spans (start, end)."""
    data, kept, removed, n, end, begin = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0, None
    for a, b in sorted(spans):
        if begin is None or a > end:
            n += 1
            kept.append(data[end:a])
            begin, start = a, a
        else:
            start = end
        removed += max(0, b - start)
        end = max(end, b)
    kept.append(data[end:])
    return removed, n, b"".join(kept)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Repeat = Repeat()) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay), n_passages (maximal runs
    of words covered by windows of rule.passage_words that other documents hold as well)."""
    return _removed(docs, doc_id, text, rule, "kept")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Repeat = Repeat()) -> DataFrame:
    """The same with kept_sha256 in place of the bytes."""
    return _removed(docs, doc_id, text, rule, "kept_sha256")


def _removed(docs: DataFrame, doc_id: str, text: str, rule: Repeat, want: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("t1"), F.xxhash64(body, F.lit(7)).alias("t2"), F.octet_length(body).cast("long").alias("n_bytes"))
    rows = d.select("doc_id", "t1", "t2", "n_bytes", *([F.sha2("text", 256).alias(want)] if want == "kept_sha256" else []))
    rows = tools.stage(rows)
    least = min(rule.length, 2 * rule.passage_words - 1)  # bytes of a text that may lose or share something
    counts = rows.where(F.col("n_bytes") >= least).groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            made = [(np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)]  # text, place, h, worded
            for part in _pieces(texts, rule):
                owner, offset = np.array([p[0] for p in part]), np.array([p[1] for p in part])
                k, at, h = anchors([p[2] for p in part], rule)
                if len(k):
                    made.append((owner[k], at + offset[k], h, np.zeros(len(k), bool)))
            for part in _word_pieces(texts, rule):
                owner, offset = np.array([p[0] for p in part]), np.array([p[1] for p in part])
                k, _, at, h, _ = passages([p[2] for p in part], rule)
                if len(k):
                    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (at[1:] != at[:-1])])
                    made.append((owner[k[new]], at[new] + offset[k[new]], h[new], np.ones(len(new), bool)))
            text, place, h, worded = map(np.concatenate, zip(*made))
            order = np.argsort(text, kind="stable")
            ends = np.searchsorted(text[order], np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in (place, h, worded)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["t1", "t2", "place", "h", "worded"])
            yield out.filter(pa.array(ends[1:] > ends[:-1]))

    # a row for each text, so that its many places share one key
    long_ones = d.where(F.col("n_bytes") >= least)
    by_text = long_ones.select("t1", "t2", "text").mapInArrow(find, "t1 long, t2 long, place array<long>, h array<long>, worded array<boolean>")
    by_text = tools.stage(by_text.dropDuplicates(["t1", "t2"]))
    places = by_text.select("t1", "t2", F.explode(F.arrays_zip("place", "h", "worded")).alias("x")).select("t1", "t2", "x.*")
    again = tools.stage(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    n_places = by_text.agg(F.sum(F.size("h"))).first()[0] or 0
    # a seed that holds over 1 / hot_seeds of all places is one of at most hot_seeds, which are
    # broadcast, so its places are found where they lie; the others meet in a shuffle
    known = again.select("h", (F.col("n") >= rule.wide_seed).alias("wide"))
    hot = F.broadcast(again.where(F.col("n") * rule.hot_seeds > n_places).select("h", (F.col("n") >= rule.wide_seed).alias("wide")))
    rest = places.join(hot.select("h"), "h", "left_anti").join(known, "h")
    wanted = places.join(hot, "h").unionByName(rest).groupBy("t1", "t2")
    lists = {"places": ~F.col("worded"), "wide": ~F.col("worded") & F.col("wide"), "spots": F.col("worded")}
    wanted = wanted.agg(*(F.collect_set(F.when(of, F.col("place"))).alias(c) for c, of in lists.items()))
    wanted = wanted.join(counts, ["t1", "t2"]).select("t1", "t2", "first", *lists)
    texts = d.join(wanted.withColumnRenamed("t1", "u1").withColumnRenamed("t2", "u2"), (d.t1 == F.col("u1")) & (d.t2 == F.col("u2")) & d.doc_id.eqNullSafe(F.col("first")))
    texts = tools.stage(texts.select("t1", "t2", "text", "places", "wide", "spots"))
    shared = _shared_passages(texts.where("size(spots) > 0").select("t1", "t2", "text", "spots"), rule)
    worded = by_text.where(F.array_contains("worded", True)).select("t1", "t2", F.lit(True).alias("worded"))
    texts = texts.where("size(places) > 0").select("t1", "t2", "text", "places", "wide")
    n_anchors = texts.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = max(1, -(-n_anchors // rule.part_rows))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _neighbourhoods(batches, rule, parts)

    found = tools.stage(texts.mapInArrow(near, "t1 long, t2 long, place long, c1 long, c2 long, part long, run binary"))
    members = found.where("run is null").select("t1", "t2", "place", "c1", "c2").distinct()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []

        def rows(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
            out = list(reaches(runs, rule))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["c1", "c2", "left", "right"])

        for batch in batches:
            for p, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part:
                    yield from rows(runs)
                    part, runs = p, []
                runs.append(run)
        yield from rows(runs)

    dealt = found.where("run is not null").select("part", "run").repartition(parts, "part").sortWithinPartitions("part")
    between = dealt.mapInArrow(merge, "c1 long, c2 long, left long, right long").groupBy("c1", "c2").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    size = members.groupBy("c1", "c2").agg(F.count("*").alias("n"))
    reach = tools.stage(size.join(between, ["c1", "c2"], "left").where("n > 1 or right is not null"))
    spans = members.join(reach, ["c1", "c2"])
    # a class of several members recurs as far as its strings go, up to the window on the right
    spans = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("place", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"), (F.col("n") > 1).alias("copied"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            out = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                size, own = len(text.encode("utf-8", "surrogatepass")), []
                for s in spans:
                    at, left, right = s["place"], s["left"], s["right"]
                    if s["copied"]:
                        most = min(rule.length - rule.seed, at), min(rule.length, size - at)
                        if sum(most) >= rule.length:
                            left, right = most
                    if right:
                        own.append((at - left, at + right))
                removed, n, kept = _cut(text, own, rule)
                out.append((removed, n, hashlib.sha256(kept).hexdigest() if want == "kept_sha256" else kept))
            removed, n, kept = zip(*out) if out else [()] * 3
            kinds = pa.string() if want == "kept_sha256" else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, kinds)], ["t1", "t2", "n_removed", "n_spans", "cut"])

    joined = texts.select("t1", "t2", "text").dropDuplicates(["t1", "t2"]).join(spans, ["t1", "t2"]).select("t1", "t2", "text", "spans")
    result = tools.stage(joined.mapInArrow(cut, f"t1 long, t2 long, n_removed long, n_spans long, cut {'string' if want == 'kept_sha256' else 'binary'}"))
    told = counts.drop("first").join(result, ["t1", "t2"], "left").join(worded, ["t1", "t2"], "left").join(shared, ["t1", "t2"], "left")
    if want == "kept":
        rows = d.select("doc_id", "t1", "t2", "n_bytes", F.col("text").cast("binary").alias("kept"))
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    all_gone = copied & (F.col("n_bytes") >= rule.length)
    empty = F.lit(hashlib.sha256(b"").hexdigest()) if want == "kept_sha256" else F.lit(b"")
    return rows.join(told, ["t1", "t2"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, empty).otherwise(F.coalesce("cut", want)).alias(want),
        F.when(copied & F.coalesce("worded", F.lit(False)), F.lit(1)).otherwise(F.coalesce("n_passages", F.lit(0))).cast("long").alias("n_passages"),
    )


def _shared_passages(texts: DataFrame, rule: Repeat) -> DataFrame:
    """(t1, t2, n_passages) of the texts with a window of words that another text has, from (t1, t2, text, spots)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            spots = [np.sort(np.array(s, np.int64)) for s in batch.column(3).to_pylist()]
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in _word_pieces(texts, rule):
                owner, offset = np.array([p[0] for p in part]), np.array([p[1] for p in part])
                k, first, at, _, whole = passages([p[2] for p in part], rule)
                if not len(k):
                    continue
                ends = np.searchsorted(k, np.arange(len(part)), "right")
                mine = np.concatenate([np.isin(at[a:b] + offset[i], spots[owner[i]]) for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends))])
                i = owner[k[mine]]
                yield pa.RecordBatch.from_arrays([pa.array(t1[i]), pa.array(t2[i]), pa.array(first[mine] + offset[k[mine]]), pa.array(whole[mine])], ["t1", "t2", "first", "h"])

    found = tools.stage(texts.mapInArrow(windows, "t1 long, t2 long, first long, h long"))
    common = tools.stage(found.groupBy("h").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a <> b").select("h"))
    # two stored tables, so that Spark may split a hot window
    firsts = found.join(common, "h", "left_semi").groupBy("t1", "t2").agg(F.sort_array(F.collect_set("first")).alias("f"))
    runs = F.size(F.filter("f", lambda x, i: (i == 0) | (x > F.get("f", i - 1) + rule.passage_words)))
    return firsts.select("t1", "t2", runs.cast("long").alias("n_passages"))
