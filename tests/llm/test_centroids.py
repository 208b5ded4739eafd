"""Clusters against plain rounds of exact assignment, and the bounds that geometry gives."""

import hashlib

import numpy as np

from tidepanel.llm import centroids


def plain(rows, clusters, rounds, dimensions, scale=64.0):
    import math

    held = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            held.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in v]))
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in held if i is not None)
    centers = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for t in range(rounds + 1):
        found = [nearest(v) for _, v in held]
        if t < rounds:
            for j in range(len(centers)):
                own = [v for (_, v), (_, k) in zip(held, found, strict=True) if k == j]
                if own:
                    centers[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    total = sum(d for d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, k, d, sum(e for e, j in found if j == k), total, digest[k]) for (i, _), (d, k) in zip(held, found, strict=True)), key=str)


def test_matches_plain_rounds(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(i % 5, 1.0, 6)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (900, None), (901, [1.0]), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, v int")
    for clusters, rounds in ((5, 3), (16, 4), (1, 2), (500, 1)):
        got = sorted((tuple(r) for r in centroids.clustered(table, clusters, rounds, 6).collect()), key=str)
        assert got == plain(rows, clusters, rounds, 6)


def test_bounds_save_scans(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    points = centroids.kept(table)
    scans = []
    for state, at in centroids.rounds(points, centroids.seeds(points)):
        out = state.collect()
        scans.append(sum(r.scanned for r in out) / len(out))
        rows = np.array([r.v for r in out])
        cluster, distance, _ = centroids.scan(rows, at)
        assert cluster.tolist() == [r.cluster for r in out] and distance.tolist() == [r.distance for r in out]
        others = np.sqrt(centroids.squares(rows, at).astype(float))
        others[np.arange(len(rows)), cluster] = np.inf
        assert (np.array([r.bound for r in out]) <= others.min(axis=1)).all()
    assert scans[0] == 1.0 and scans[-1] < 1.0


def test_gain_covers_every_point_of_the_sphere():
    draw = np.random.default_rng(2)
    less = 0
    for _ in range(200):
        old = draw.integers(-50, 50, (4, 3))
        new = old + draw.integers(-20, 20, (4, 3))
        radius = draw.uniform(0, 60, 4)
        bound = centroids.gains(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(axis=1))
        assert (bound <= drift * 1.001 + 1e-6).all()
        less += (bound < 0.9 * drift).sum()
        for i in range(4):
            x = draw.normal(size=(500, 3))
            x *= radius[i] * draw.uniform(0, 1, (500, 1)) ** 0.2 / np.linalg.norm(x, axis=1, keepdims=True)
            x += old[i]
            for j in range(4):
                gain = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert gain.max() <= bound[i, j] + 1e-9
    assert less > 300


def test_empty_and_too_large(spark):
    import pytest

    empty = centroids.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.clustered(spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()
