"""Clusters of vectors against plain Python, which compares all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from selvage.llm.centroids import Bisectors, cluster_vectors


def plainly(rows, k, rounds, dims, scale=1024, seed="3:"):
    """(id, cluster, distance, inertia of the cluster, inertia, centroid) of each proper row."""
    good = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(((hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest(), v) for i, v in good))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        members = {}
        for _, v in good:
            members.setdefault(near(v), []).append(v)
        centroids = [[sum(x) // len(members[c]) for x in zip(*members[c])] if c in members else old for c, old in enumerate(centroids)]
    out = [(i, near(v), far(v, centroids[near(v)])) for i, v in good]
    own = {}
    for _, c, d in out:
        own[c] = own.get(c, 0) + d
    return sorted(((i, c, d, own[c], sum(own.values()), centroids[c]) for i, c, d in out), key=repr)


def told(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in df.collect()), key=repr)


def test_clusters_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(n, [rng.choice([-0.5, 0.0, 0.25, rng.random()]) for _ in range(4)]) for n in range(120)]
    rows += [(n, [0.25, 0.25, 0.0, -0.5]) for n in range(200, 260)]  # one very common vector
    rows += [(5, rows[5][1]), (5, [1.0, 2.0, 3.0, 4.0]), (None, [0.1, 0.2, 0.3, 0.4])]
    rows += [(300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 1.0, 1.0]), (304, [1.0, float("nan"), 1.0, 1.0]), (305, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", n) for n, (i, v) in enumerate(rows)], "vec_id long, embedding array<float>, cluster string, `a.b` int")
    got = cluster_vectors(df, k=5, rounds=6, dims=4)
    assert got.columns == ["vec_id", "embedding", "a.b", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert told(got) == plainly(rows, 5, 6, 4)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert told(cluster_vectors(df, dims=2)) == plainly([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 8, 10, 2)
    assert cluster_vectors(df.where("false"), dims=2).collect() == []


def test_large_components(spark):
    """Beyond doubles and longs the games are played with Python's integers; what a long can't hold is null."""
    rows = [(n, [float(s * 2**p), 1.0]) for n, (s, p) in enumerate([(1, 10), (-1, 10), (1, 17), (-1, 20), (1, 30), (-1, 30), (1, 43), (-1, 43), (1, 3)])]
    got = told(cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, rounds=3, dims=2))
    held = lambda v: v if abs(v) < 1 << 63 else None
    want = [(i, c, held(d), held(o), held(a), list(x)) for i, c, d, o, a, x in plainly([(i, v) for i, v in rows], 3, 3, 2)]
    assert [(g[0], g[1], g[2], g[3], g[4]) for g in got] == [w[:5] for w in sorted(want, key=repr)]


@pytest.mark.parametrize("width", [3, 1 << 20, 1 << 28, 1 << 40])
def test_tournament_is_the_nearest(width):
    """Ties and repeated centroids go to the smaller number, in each kind of numbers."""
    rng = np.random.default_rng(width % 97)
    x = rng.integers(-width, width + 1, (400, 3))
    centroids = rng.integers(-width, width + 1, (7, 3)).tolist()
    centroids[4] = centroids[1]
    x[:20] = centroids[4]
    x[20:30] = [(a + b) // 2 for a, b in zip(centroids[0], centroids[2])]
    games = Bisectors(centroids)
    far = lambda v, c: sum((int(a) - int(b)) ** 2 for a, b in zip(v, c))
    want = [min(range(7), key=lambda c: (far(v, centroids[c]), c)) for v in x.tolist()]
    best = games.winners(x)
    assert best.tolist() == want and games.distances(x, best) == [far(v, centroids[c]) for v, c in zip(x.tolist(), want)]

