"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments of 32 bits, and each segment has a table. A fingerprint's home entry
is its segment's value; it also looks into the entries of the small Hamming ball around that value. Of
two values one bit apart the lower one looks into the upper's home, so half a ball will do. All
that meet in an entry are candidates, and links are those whose complete distance is within the limit.

`fingerprint_components` links 64-bit fingerprints at two differing bits or fewer, exactly: with two
segments, one of them differs in at most one bit, so balls of radius one miss nothing. An entry of more than
`crowd` fingerprints is not compared within: its members meet again in a table of the whole key (both
segments, with one bit flipped), whose entries hold only fingerprints within two bits of each other, so
chains of neighbours link a group in linear work, however large it is.

`near_duplicates` is the filter: word-set fingerprints of 128 bits find candidates through
four segments with balls of radius one, and bands of shingle minima find those whose differences
lie together. Five-word-shingle fingerprints drop candidates that are far beyond the limit, and the
rest are verified by the Jaccard similarity of their shingle sets, 0.8 or more. Entries of up to `crowd`
texts are compared in full. In larger ones each text meets a random partner and the first, which links copies in linear
work; what that may have left apart is found exactly: of two texts at the similarity, the rarest fifth of
the shingles of one has a shingle of the other's rarest fifth, so texts of crowded entries that share such a
shingle and are not yet in one group are verified too.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated
rows are copies of each other; ties are settled by the smaller doc_id; an empty table gives an
empty one; other columns pass through the filter untouched.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import _tools as tools
from foliant.llm.components import components

_BLOCK = 1 << 17


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """k-word shingles with repeats; fewer words give the whole sequence, none give none."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def hashes(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(42)), np.uint64, len(items))


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """n 64-bit words from each hash, the first the hash itself."""
    out = np.empty((len(h), n), np.uint64)
    out[:, 0] = h
    for i in range(1, n):
        z = h + np.uint64((0x9E3779B97F4A7C15 * i) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = z ^ (z >> np.uint64(31))
    return out


def fingerprints(groups: list[np.ndarray], n: int = 1) -> np.ndarray:
    """An n x 64-bit fingerprint of each group of hashes: bits set in over half of them."""
    sizes = np.array([len(g) for g in groups], np.int64)
    counts = np.zeros((len(groups), 64 * n), np.int64)
    flat = np.concatenate(groups) if groups else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(groups)), sizes)
    for i in range(0, len(flat), _BLOCK):
        mine = owner[i : i + _BLOCK]
        bits = np.unpackbits(_mixed(flat[i : i + _BLOCK], n).view(np.uint8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        counts[mine[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64)


def _by_slices(batch: pa.RecordBatch, of: callable, at_most: int = 4_000_000) -> np.ndarray:
    """of(texts) for consecutive slices of bounded size of the batch's second column."""
    texts, out, begin, size = batch.column(1).to_pylist(), [], 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > at_most or i + 1 == len(texts):
            out.append(of(texts[begin : i + 1]))
            begin, size = i + 1, 0
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint of ASCII-lowered k-word shingles as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(texts: list[str | None]) -> np.ndarray:
            return fingerprints([hashes(shingles(tools.lower_bytes(t).split(), k)) for t in texts])[:, 0]

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_by_slices(batch, of).view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


SEGMENT_BITS, CROWD = 32, 64


def _segment_tables(df: DataFrame, own: str, words: list[str]) -> DataFrame:
    """(own, entry, home): of each segment of the words its home entry and the entries one set bit above it."""
    halves = [F.shiftrightunsigned(w, k * SEGMENT_BITS).bitwiseAND(F.lit(0xFFFFFFFF)) for w in words for k in range(2)]
    cut = df.select(own, F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("s"), v.alias("v")) for s, v in enumerate(halves)))).alias("x")).select(own, "x.s", "x.v")
    above = F.filter(F.array(*(F.lit(1 << i) for i in range(SEGMENT_BITS))), lambda m: F.col("v").bitwiseAND(m) == 0)
    looked = cut.select(own, "s", "v", F.explode(F.concat(F.array(F.lit(0).cast("long")), above)).alias("flip"))
    return looked.select(own, F.col("v").bitwiseXOR(F.col("flip")).bitwiseXOR(F.shiftleft("s", SEGMENT_BITS)).alias("entry"), (F.col("flip") == 0).alias("home"))


def _meetings(table: DataFrame, own: str, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Entries in which something can meet: lone pairs (a, b), and the rows of the larger ones with their size n."""
    entries = table.groupBy("entry").agg(F.count("*").alias("n"), F.min(own).alias("a"), F.max(own).alias("b"), F.bool_or("home").alias("homes"))
    entries = tools.stage(entries.where("n > 1 and homes"))
    larger = tools.broadcast_if_small(entries.where("n > 2").select("entry", "n"))
    return entries.where("n = 2").select("a", "b"), tools.stage(table.join(larger, "entry"))


def _within(rows: DataFrame, me: Column, close: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs (a, b) of a home and any other member of an entry that are close; entries are small.

    me is a struct that starts with `id`.
    """
    groups = rows.groupBy("entry").agg(F.collect_list(F.when(F.col("home"), me)).alias("homes"), F.collect_list(me).alias("every"))
    found = F.flatten(F.transform("homes", lambda x: F.transform(F.filter("every", lambda y: (x["id"] != y["id"]) & close(x, y)), lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")))))
    return groups.select(F.explode(found).alias("p")).select("p.a", "p.b")


def _whole_key_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) of neighbours in the table of the whole key, one bit of which is flipped."""
    flips = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    entries = fps.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    before = F.lag("fp").over(Window.partitionBy("point").orderBy("fp"))
    return entries.select(before.alias("a"), F.col("fp").alias("b")).where(F.col("a").isNotNull())


def ball_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints `fp` at distance two or less."""
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 2
    lone, larger = _meetings(_segment_tables(fps, "fp", ["fp"]), "fp", crowd)
    links = lone.where(close(F.col("a"), F.col("b")))
    links = links.union(_within(larger.where(F.col("n") <= crowd), F.struct(F.col("fp").alias("id")), lambda x, y: close(x["id"], y["id"])))
    return links.union(_whole_key_links(larger.where(F.col("n") > crowd).select("fp").distinct())).distinct()


def fingerprint_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over links of <= 2 bits."""
    marked = tools.stage(with_fingerprint(docs, doc_id, text, k))
    distinct = tools.stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(ball_links(distinct))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = tools.stage(labelled)
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = labelled.join(least, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---- the near-duplicate filter -------------------------------------------------------------

SEGMENTS, VERIFY_WORDS = 4, 2
#: 16 bands of 4 minima: 0.9998 of the pairs at a similarity of 0.8 share one.
BANDS, BAND_ROWS = 16, 4
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS, BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_MARKS = re.compile(r"[^\w\s]+")


def _max_distance(similarity: float, bits: int, deviations: float = 6) -> int:
    """Bits within which pairs of a shingle similarity lie: the mean and six standard deviations.

    The mean is an angle: cos = 2j / (1 + j) on sets of equal size.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _plain_words(text: str | None) -> list[bytes]:
    return _MARKS.sub("", (text or "").lower()).encode("utf-8", "surrogatepass").split()


def _shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles, sorted."""
    return np.unique(hashes(list(set(shingles(words, k)))))


def _bands(groups: list[np.ndarray]) -> np.ndarray:
    """BANDS hashes of BAND_ROWS minima each, per group of hashes; empty groups are alike."""
    out = np.zeros((len(groups), BANDS), np.uint64)
    full = [i for i, g in enumerate(groups) if len(g)]
    if not full:
        return out
    for begin in range(0, len(full), 64):
        some = full[begin : begin + 64]
        flat = np.concatenate([groups[i] for i in some])
        starts = np.r_[0, np.cumsum([len(groups[i]) for i in some])[:-1]]
        for j in range(BANDS):
            key = np.zeros(len(some), np.uint64)
            for factor in _FACTORS[j]:
                key = (key ^ np.minimum.reduceat(flat * factor, starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[some, j] = key
    return out


def _prints(texts: list[str | None], k: int) -> np.ndarray:
    """Per text: the words of the word-set fingerprint, VERIFY_WORDS of the k-shingle one, the bands, the number of shingles and a hash of them all."""
    wordsets, shingled = [], []
    for text in texts:
        words = _plain_words(text)
        wordsets.append(hashes(list(set(words))))
        shingled.append(_shingle_set(words, k))
    sizes = np.array([len(s) for s in shingled], np.uint64)[:, None]
    whole = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in shingled], np.uint64)[:, None]
    return np.hstack([fingerprints(wordsets, SEGMENTS * SEGMENT_BITS // 64), fingerprints(shingled, VERIFY_WORDS), _bands(shingled), sizes, whole])


def _table(classes: DataFrame) -> DataFrame:
    """(id, entry, home) of the segment tables of the word sets and of the bands."""
    segments = _segment_tables(classes, "id", [f"w{i}" for i in range(SEGMENTS // 2)])
    keys = F.array(*(F.xxhash64(F.lit(SEGMENTS + j), F.col(f"m{j}")) for j in range(BANDS)))
    return segments.union(classes.select("id", F.explode(keys).alias("entry"), F.lit(True).alias("home")))


def _partners(crowded: DataFrame, per_salt: int = 1000) -> DataFrame:
    """Pairs (a, b) that connect every entry, linear in its size: each id with the one before it, in
    an order of the entry's own, and with the first; parts of large entries by their first ids."""
    salted = crowded.withColumn("salt", F.pmod(F.xxhash64("id", "entry"), F.ceil(F.col("n") / per_salt)))
    inner = Window.partitionBy("entry", "salt").orderBy(F.xxhash64("entry", "id"))
    linked = salted.select("entry", "id", "n", F.lag("id").over(inner).alias("before"), F.first("id").over(inner).alias("head"))
    heads = linked.where(F.col("before").isNull() & (F.col("n") > per_salt))
    outer = heads.select(F.lag("id").over(Window.partitionBy("entry").orderBy(F.xxhash64("entry", "id"))).alias("a"), F.col("id").alias("b"))
    pairs = linked.select(F.explode(F.array_distinct(F.array("before", "head"))).alias("a"), F.col("id").alias("b")).union(outer)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts in different groups that share one of their rarest shingles: all that can be similar.

    sets: id, shingles. Groups of a shingle meet by the texts outside its commonest group only.
    """
    each = sets.select("id", F.explode("shingles").alias("s"))
    ranked = each.join(each.groupBy("s").agg(F.count("*").alias("f")), "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("r"))
    size = F.size("r")
    rare = ranked.select("id", F.explode(F.slice("r", F.lit(1), (size - F.ceil(F.lit(similarity) * size) + 1).cast("int"))).alias("x")).select("id", "x.s")
    roots = components(links)
    rare = tools.stage(rare.join(roots, rare.id == roots.node, "left").select("s", "id", F.coalesce("root", "id").alias("group")))
    groups = rare.groupBy("s", "group").agg(F.count("*").alias("n")).groupBy("s").agg(F.max_by("group", "n").alias("main"), F.count("*").alias("k")).where("k > 1")
    stray = tools.stage(rare.join(groups, "s").where("group <> main").select("s", F.col("id").alias("x"), F.col("group").alias("g"), "main"))
    met = tools.broadcast_if_small(stray).join(rare, "s").where((F.col("group") != F.col("g")) & ((F.col("group") == F.col("main")) | (F.col("x") < F.col("id"))))
    return met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_hash and group of every row; equal (doc_id, text) rows stay repeated.

    group is the hash of one text of the group. Texts with equal shingles after lowering letters and
    dropping marks form one class before any search.
    """
    n = SEGMENTS * SEGMENT_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                prints = _by_slices(batch, lambda texts: _prints(texts, k)).view(np.int64)
                arrays = [batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(p)) for p in prints.T)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "text_hash", *(f"w{i}" for i in range(n)), *(f"v{i}" for i in range(VERIFY_WORDS)), *(f"m{i}" for i in range(BANDS)), "size", "id"]
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    marked = tools.stage(slim.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:])))
    prints = names[2:-1]
    classes = tools.stage(marked.groupBy("id").agg(F.min("text_hash").alias("text_hash"), *(F.min(p).alias(p) for p in prints)))
    known = ["size", *(f"v{i}" for i in range(VERIFY_WORDS))]
    most = _max_distance(similarity, 64 * VERIFY_WORDS)

    def close(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        far = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in known[1:]), F.lit(0))
        return (F.least(x("size"), y("size")) >= similarity * F.greatest(x("size"), y("size"))) & (far <= most)

    def of(side: str) -> DataFrame:
        return classes.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in known))

    lone, larger = _meetings(_table(classes), "id", crowd)
    crowded = tools.stage(larger.where(F.col("n") > crowd).select("entry", "id", "n"))
    some = lone.union(_partners(crowded)).distinct().join(of("a"), "a").join(of("b"), "b").where(close(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))
    small = larger.where(F.col("n") <= crowd).join(classes.select("id", *known), "id")
    inside = _within(small, F.struct("id", *known), lambda x, y: close(x.getItem, y.getItem))
    pairs = tools.stage(some.select("a", "b").union(inside).distinct())
    links = tools.stage(_verified(pairs, _sets(slim, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")), k), similarity))
    ids = tools.stage(crowded.select("id").distinct())
    if ids.limit(1).count():
        sets = _sets(slim, classes, ids, k)
        links = links.union(_verified(_apart(sets, links, similarity), sets, similarity))
    roots = components(links)
    return marked.join(roots, marked.id == roots.node, "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("group"))


def _sets(slim: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Staged (id, shingles) of the classes in ids; only their texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = pa.array([_shingle_set(_plain_words(text), k).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), own], ["id", "shingles"])

    wanted = tools.stage(classes.join(ids.distinct(), "id").select("id", F.col("text_hash").alias("__hash")))
    wanted = tools.broadcast_if_small(wanted)
    texts = slim.join(wanted, slim.text_hash == F.col("__hash")).select("id", "text")
    return tools.stage(texts.mapInArrow(run, "id long, shingles array<long>").dropDuplicates(["id"]))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """The documents without near copies: of each group the row of the smallest doc_id stays."""
    groups = tools.stage(duplicate_groups(docs, doc_id, text, k, similarity, crowd))
    key = F.struct(F.col("doc_id"), F.col("text_hash"))
    best = groups.groupBy("group").agg(F.min(key).alias("best"))
    losers = groups.join(best, "group").where(key != F.col("best"))
    gone = tools.stage(losers.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    again = tools.stage(groups.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    own_hash = F.xxhash64(F.coalesce(docs[text], F.lit("")))

    def met(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        small = tools.broadcast_if_small(keys)
        return df.join(small, df[doc_id].eqNullSafe(small["__id"]) & (own_hash == small["__hash"]), how)

    kept = met(docs, gone, "left_anti")
    if not again.limit(1).count():
        return kept
    twice = met(kept, again, "left_semi").withColumn("__text_hash", own_hash).dropDuplicates([doc_id, "__text_hash"]).drop("__text_hash")
    return met(kept, again, "left_anti").unionByName(twice)
