import hashlib
import math
import random

import numpy as np

from barloom.llm import bisector

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"


def brute(rows, k, rounds, dims, seed):
    """Python integers, all distances."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else 1024 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centers = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centers)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in last:
        inertia[j] = inertia.get(j, 0) + d
    long = lambda v: v if v < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, long(d), long(inertia[j]), long(sum(inertia.values())), sha[j]) for i, d, j in last), key=str)


def run(spark, rows, k=4, rounds=3, dims=3, seed=3):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in bisector.cluster(df, k, rounds, dims, seed).collect()), key=str)


def test_equals_all_distances(spark):
    draw = random.Random(1)
    rows = [(i, [draw.choice([0.0, 0.25, -0.5, draw.gauss(0, 1)]) for _ in range(3)]) for i in range(200)]
    rows += rows[:20] + [(None, [0.1, 0.2, 0.3]), (500, None), (501, []), (502, [1.0, None, 2.0]), (503, [float("nan"), 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0]), (505, [1.0] * 4)]
    for k in (1, 4, 7):
        assert run(spark, rows, k) == brute(rows, k, 3, 3, 3)


def test_ties_go_to_the_smaller_centroid(spark):
    rows = [(i, v) for i, v in enumerate([[0.0] * 3, [0.0] * 3, [2.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0]])]
    assert run(spark, rows, 3, 1) == brute(rows, 3, 1, 3, 3)


def test_huge_values_stay_exact(spark):
    rows = [(i, [s * 3.4e38, s * i, 1e15 + i]) for i, s in enumerate([1.0, -1.0, 0.5, 2.0**-128, 0.0, 1e-30])]
    assert run(spark, rows, 3) == brute(rows, 3, 3, 3, 3)
    assert any(r[2] is None for r in run(spark, rows, 3))


def test_few_and_no_vectors(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []
    assert run(spark, [(1, [1.0, 2.0, 3.0])], 8) == brute([(1, [1.0, 2.0, 3.0])], 8, 3, 3, 3)


def test_tournament_equals_least_distance():
    draw = np.random.default_rng(2)
    for _ in range(50):
        planes = bisector.Bisectors(draw.integers(-5, 6, (6, 4)).tolist())
        vectors = draw.integers(-5, 6, (100, 4))
        best, distance = planes.nearest(vectors)
        all_ = ((vectors[:, None, :] - np.array(planes.centroids)[None]) ** 2).sum(axis=2)
        assert (best == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
