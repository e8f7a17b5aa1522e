"""Centroid clustering with Elkan's bounds, exact over integers.

Vectors become integers and travel in blocks of a few thousand rows as packed arrays. Beside a block go its bounds: for
every vector the cluster, an upper bound of the distance to it, and a lower bound of the distance to each centroid. A round
moves the bounds by how far the centroids went, and skips every distance that the bounds or the distances between
centroids show to be larger. What is left is computed as integers, so ties are ties.

Bounds are doubles, always rounded away from a wrong conclusion, and a centroid is passed over only where it is strictly
farther; one that is equally near is always computed and the smaller number wins. Blocks with their bounds are persisted
from round to round (memory first, then disk) and the round before is released; a lost block is computed again from
the staged vectors, since every round is a function of the centroids so far. The driver holds k centroids and gets k sums a round.

Cases: vectors of another length, null ones, and ones with a null or non-finite component (or one of 2^128 and more)
are left out. Repeated rows count each. A null id is kept but is a start only after all others. With fewer
vectors than k there are as many centroids as vectors; with none the result is empty. A distance or sum that a long can't hold is null.
Equal starts: the later one stays empty where it is. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from foliant.llm import _tools as tools

BLOCK_ROWS = 4096
_BLOCK = "ids binary, named binary, vectors binary, cluster binary, upper binary, lower binary, computed binary"
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
#: Sums travel as limbs of 30 bits, which holds the sum of any number of 32-bit floats times 1024.
_LIMB, _LIMBS = 30, 7
#: Below this size, 64-bit arithmetic is exact: the square of a difference is under 2^56, and 64 of them under 2^62.
_SMALL = 1 << 27
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


# ---- exact arithmetic ----------------------------------------------------------------------


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in 64 bits where that is safe, else as Python integers."""
    f = np.floor(scale * x.astype(np.float64))
    return f.astype(np.int64) if not f.size or np.abs(f).max() < _SMALL else np.array([int(v) for v in f.ravel()], object).reshape(f.shape)


def small(c: np.ndarray) -> np.ndarray:
    """Centroids in 64 bits if they fit."""
    return c.astype(np.int64) if not c.size or max(abs(int(v)) for v in c.ravel()) < _SMALL else c


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to one centroid or to a row each; Python integers if any is large."""
    if v.dtype == object or c.dtype == object or v.shape[-1] > 64:
        v, c = v.astype(object), c.astype(object)
    d = v - c
    return (d * d).sum(axis=-1)


def roots(squared: np.ndarray, factor: float) -> np.ndarray:
    """Distances as doubles, moved up or down by more than their error."""
    return np.sqrt(squared.astype(np.float64)) * factor


# ---- one round over one block --------------------------------------------------------------


class Centroids:
    """The centroids of a round, what lies between them, and how far each came (never less than it did)."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.at = small(now)
        k = len(now)
        apart = np.array([roots(squares(self.at, self.at[j]), _DOWN) for j in range(k)]).reshape(k, k)
        self.half = apart / 2  # never more than half the distance
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1) / 2
        self.moved = roots(squares(self.at, small(before)), _UP) if before is not None else np.zeros(k)


def first_round(v: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower, and how many distances each row cost: all of them."""
    far = np.array([squares(v, x) for x in c.at]).T.reshape(len(v), len(c.at))
    cluster = far.argmin(axis=1) if len(v) else np.zeros(0, np.int64)  # the first of equals
    best = far[np.arange(len(v)), cluster]
    return cluster.astype(np.int32), roots(best, _UP), roots(far, _DOWN), len(c.at)


def next_round(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after the centroids moved; the last tells how many distances each row cost."""
    cluster, cost = cluster.copy(), np.zeros(len(v), np.int32)
    upper = (upper + c.moved[cluster]) * _UP
    lower = np.maximum(lower - c.moved, 0) * _DOWN
    rows = np.flatnonzero(upper >= c.nearest[cluster])

    def open_to(rows: np.ndarray, j: int) -> np.ndarray:
        """Rows whose bounds leave it open whether centroid j is as near as their own."""
        a = cluster[rows]
        return rows[(a != j) & (upper[rows] >= lower[rows, j]) & (upper[rows] >= c.half[a, j])]

    doubtful = np.unique(np.concatenate([open_to(rows, j) for j in range(len(c.at))] or [rows]))
    if not len(doubtful):
        return cluster, upper, lower, cost
    # the exact distance to the own centroid, once for each row in doubt
    best = np.zeros(len(v), object if v.dtype == object or c.at.dtype == object else np.int64)
    best[doubtful] = squares(v[doubtful], c.at[cluster[doubtful]])
    upper[doubtful] = roots(best[doubtful], _UP)
    lower[doubtful, cluster[doubtful]] = roots(best[doubtful], _DOWN)
    cost[doubtful] += 1
    for j in range(len(c.at)):
        at = open_to(doubtful, j)
        if not len(at):
            continue
        far = squares(v[at], c.at[j])
        lower[at, j] = roots(far, _DOWN)
        cost[at] += 1
        nearer = np.asarray((far < best[at]) | ((far == best[at]) & (j < cluster[at])), bool)
        won = at[nearer]
        cluster[won], best[won] = j, far[nearer]
        upper[won] = roots(best[won], _UP)
    return cluster, upper, lower, cost


# ---- blocks --------------------------------------------------------------------------------


def _packed(v: np.ndarray) -> bytes:
    """S and 64-bit integers, or B and decimal ones by line."""
    return b"S" + v.tobytes() if v.dtype != object else b"B" + "\n".join(map(str, v.ravel())).encode()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(raw, np.int64, offset=1) if raw[:1] == b"S" else np.array([int(x) for x in raw[1:].split(b"\n")], object)
    return flat.reshape(-1, width)


def _block(ids: np.ndarray, named: np.ndarray, v: np.ndarray, cluster=b"", upper=b"", lower=b"", computed=b"") -> pa.RecordBatch:
    raw = [ids.tobytes(), named.tobytes(), _packed(v), *(x if isinstance(x, bytes) else x.tobytes() for x in (cluster, upper, lower, computed))]
    return pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in raw], _NAMES)


def _opened(batch: pa.RecordBatch, i: int, width: int, k: int):
    ids, named, v, cluster, upper, lower, computed = (batch.column(c)[i].as_py() for c in _NAMES)
    state = (np.frombuffer(cluster, np.int32), np.frombuffer(upper, np.float64), np.frombuffer(lower, np.float64).reshape(-1, k), np.frombuffer(computed, np.int64)) if cluster else None
    return np.frombuffer(ids, np.int64), np.frombuffer(named, bool), _unpacked(v, width), state


def blocks(vectors: DataFrame, vec_id: str, embedding: str, width: int, scale: int) -> DataFrame:
    """The vectors that count, as integers, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                ids = part.column("id")
                yield _block(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), integers(flat.reshape(-1, width), scale))

    return usable(vectors, vec_id, embedding, width).mapInArrow(run, _BLOCK)


def usable(vectors: DataFrame, vec_id: str, embedding: str, width: int) -> DataFrame:
    """id and v (doubles) of the vectors that count."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**128)))
    return vectors.where((F.size(v) == width) & finite).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def starts(vectors: DataFrame, vec_id: str, embedding: str, width: int, scale: int, k: int, seed: str) -> np.ndarray:
    """The k vectors with the least hashes of seed:id, in order of these; k rows reach the driver."""
    d = usable(vectors, vec_id, embedding, width)
    hashed = d.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    rows = hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()
    got = [integers(np.array([r.v]), scale)[0] for r in rows]
    return np.array([[int(x) for x in r] for r in got], object).reshape(len(got), width)


def _stepped(state: DataFrame, now: np.ndarray, before: np.ndarray | None, width: int) -> DataFrame:
    """Blocks with the bounds of the next round."""
    k = len(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(now, before)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, named, v, held = _opened(batch, i, width, k)
                if held is None:
                    cluster, upper, lower, cost = first_round(v, c)
                    computed = np.full(len(v), cost, np.int64)
                else:
                    cluster, upper, lower, cost = next_round(v, *held[:3], c)
                    computed = held[3] + cost
                yield _block(ids, named, v, cluster, upper, lower, computed)

    return state.mapInArrow(run, _BLOCK)


_SUM = "cluster int, dim int, n long, " + ", ".join(f"s{i} long" for i in range(_LIMBS))


def _summed(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (k) and componentwise sums (k, width) of the clusters: tasks send k * width rows each, the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, v, held = _opened(batch, i, width, k)
                counts += np.bincount(held[0], minlength=k)
                for j in range(k):
                    mine = v[held[0] == j]
                    if len(mine):
                        sums[j] += mine.sum(axis=0).astype(object)  # a block's sum of small components fits 64 bits
        some = np.flatnonzero(counts)
        cells = [(int(j), d, int(counts[j]), *limbs(int(sums[j, d]))) for j in some for d in range(width)]
        columns = list(zip(*cells)) if cells else [()] * (3 + _LIMBS)
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * (1 + _LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in _SUM.split(", ")])

    parts = state.mapInArrow(run, _SUM).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(_LIMBS)))
    counts, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
    for r in parts.collect():  # k * width rows
        counts[r.cluster] = r.n
        sums[r.cluster, r.dim] = sum(r[f"s{i}"] << (_LIMB * i) for i in range(_LIMBS))
    return counts, sums


def limbs(v: int) -> list[int]:
    """v = sum of limb i times 2^(30 i); all but the last are in 0 .. 2^30 - 1."""
    out = []
    for _ in range(_LIMBS - 1):
        out.append(v & ((1 << _LIMB) - 1))
        v >>= _LIMB
    return [*out, v]


def _long(v: np.ndarray) -> pa.Array:
    return pa.array([int(x) if abs(int(x)) < 1 << 63 else None for x in v] if v.dtype == object else v, pa.int64())


def _told(state: DataFrame, c: np.ndarray, width: int) -> DataFrame:
    """vec_id, cluster, distance (exact), computed (distances that were computed for the vector) of every vector."""
    k = len(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = small(c)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, named, v, held = _opened(batch, i, width, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~named), pa.array(held[0]), _long(squares(v, at[held[0]])), pa.array(held[3])], ["vec_id", "cluster", "distance", "computed"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long, computed long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int, rounds: int, seed: str, vec_id: str = "vec_id", embedding: str = "embedding", width: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, computed of every vector that counts.

    `rounds` times all vectors are assigned and the centroids of those that have any move to the floor of
    their mean; then all are assigned once more.
    """
    spark = vectors.sparkSession
    now = starts(vectors, vec_id, embedding, width, scale, k, seed)
    k = len(now)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long")
    base = tools.stage(blocks(vectors, vec_id, embedding, width, scale))
    before, state = None, _stepped(base, now, None, width).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        counts, sums = _summed(state, k, width)
        if before is not None:
            before.unpersist()  # its successor is filled now
        then = np.array([[int(s) // int(n) for s in row] if n else list(old) for n, row, old in zip(counts, sums, now)], object).reshape(k, width)
        before, state, now = state, _stepped(state, then, now, width).persist(StorageLevel.MEMORY_AND_DISK), then
    told = tools.stage(_told(state, now, width))
    for done in (before, state):
        if done is not None:
            done.unpersist()
    held = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()  # k rows
    fits = lambda x: int(x) if x is not None and int(x) < 1 << 63 else None
    all_ = fits(sum(int(r.s or 0) for r in held))
    clusters = spark.createDataFrame([(r.cluster, fits(r.s), all_, digest(now[r.cluster])) for r in held], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "computed")
