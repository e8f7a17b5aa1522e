import hashlib
import math
import random
import struct

import numpy as np
import pytest

from foliant.llm import elkan


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def lloyd(rows, k, rounds, width, seed="3"):
    """The same by the book, in Python integers: every distance of every round."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [list(v) for _, v in hashed[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(now)), key=lambda j: (far(v, now[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(now)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                now[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    return [(i, a, far(v, now[a]), hashlib.sha256(",".join(map(str, now[a])).encode()).hexdigest()) for (i, v), a in zip(kept, at)]


def check(spark, rows, k, rounds, width):
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    got = elkan.cluster(d, k=k, rounds=rounds, seed="3", width=width).collect()
    want = lloyd(rows, k, rounds, width)
    assert sorted(((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got), key=repr) == sorted(want, key=repr)
    for j in {r.cluster for r in got}:
        assert {r.cluster_inertia for r in got if r.cluster == j} == {sum(w[2] for w in want if w[1] == j)}
    assert {r.inertia for r in got} == {sum(w[2] for w in want)}
    return got


def test_clusters_with_ties_and_odd_vectors(spark):
    rng = random.Random(9)
    grid = [[f32(rng.randrange(-2, 3) / 8) for _ in range(4)] for _ in range(250)]  # a coarse grid: many ties
    rows = list(enumerate(grid))
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, math.nan, 1.0, 1.0]), (905, [1.0, math.inf, 0.0, 0.0]), (906, [1.0] * 5)]
    rows += [(7, grid[7])] * 3 + [(None, grid[3])]
    check(spark, rows, k=6, rounds=7, width=4)


def test_blobs_skip_most_distances(spark):
    rng = np.random.default_rng(1)
    blobs = np.concatenate([rng.normal(10 * b, 0.5, (120, 8)) for b in range(5)]).astype(np.float32)
    got = check(spark, [(i, [float(x) for x in v]) for i, v in enumerate(blobs)], k=5, rounds=8, width=8)
    assert sum(r.computed for r in got) < 600 * 5 * 9 / 3


def test_large_components_stay_exact(spark):
    big = [(i, [f32(2e5 * (i % 3) + i), f32(-2e3 * i)]) for i in range(30)]
    check(spark, big, k=3, rounds=4, width=2)


def test_distances_beyond_a_long_are_null(spark):
    rows = [(i, [f32(1e30 * (i % 2) + 1e28 * i), 0.0]) for i in range(9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = elkan.cluster(d, k=2, rounds=3, seed="3", width=2).collect()
    want = {w[0]: w for w in lloyd(rows, 2, 3, 2)}
    for r in got:
        assert (r.cluster, r.centroid_sha256) == want[r.vec_id][1:4:2]
        assert r.distance == (want[r.vec_id][2] if want[r.vec_id][2] < 1 << 63 else None)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])], k=8, rounds=3, width=2)
    none = elkan.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), k=8, rounds=2, seed="3")
    assert none.collect() == [] and "centroid_sha256" in none.columns


@pytest.mark.parametrize("v", [0, 5, -1, 2**31, -(2**70) + 3, 2**150])
def test_limbs(v):
    parts = elkan.limbs(v)
    assert sum(x << (30 * i) for i, x in enumerate(parts)) == v and all(0 <= x < 1 << 30 for x in parts[:-1])


def test_bounds_hold_after_every_round():
    rng = np.random.default_rng(4)
    v = rng.integers(-2000, 2000, (400, 6))
    now = np.array(v[:7], object)
    c = elkan.Centroids(now)
    a, u, low, _ = elkan.first_round(v, c)
    for _ in range(6):
        then = np.array([[int(x) for x in v[a == j].mean(axis=0)] if (a == j).any() else list(now[j]) for j in range(7)], object)
        c, now = elkan.Centroids(then, now), then
        a, u, low, _ = elkan.next_round(v, a, u, low, c)
        far = np.array([elkan.squares(v, x) for x in c.at]).T
        assert (a == far.argmin(axis=1)).all()
        true = np.sqrt(far.astype(float))
        assert (u >= true[np.arange(400), a]).all() and (low <= true).all()
