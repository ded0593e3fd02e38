"""Centroid clustering against a plain computation in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from wattline.llm.centroids import cluster_by_centroids, nearest

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, ids string, dim int, label int"


def brute(rows, k=8, rounds=10, dim=64):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [min(max(math.floor(1024 * x), -(2**62)), 2**62) for x in v]) for i, v in kept]
    first = sorted(zip(kept, whole), key=lambda r: (hashlib.sha256(f"3:{'' if r[0][0] is None else r[0][0]}".encode()).hexdigest(), r[0][1]))
    centroids = [w[1] for _, w in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in whole:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centroids)]
    told = [(i, *near(v)) for i, v in whole]
    sums = {j: sum(d for _, d, at in told if at == j) for j in range(len(centroids))}
    most = 2**63 - 1
    return sorted(((i if i is not None else -1, j, min(d, most), min(sums[j], most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in told))


def got(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert df.columns == names
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "d", "i", 1, 2) for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 64)) * np.linspace(0.01, 3, 64)
    x[100:200] = np.round(x[100:200])  # many ties
    x[200:260] = x[200]  # one vector with many copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] + [1.0] * 63), (906, [])]
    return rows + bad + [(None, [0.5] * 64), rows[5], rows[5], (5, [-0.25] * 64)]


def test_rows_equal_a_plain_computation(spark, vectors):
    assert got(cluster_by_centroids(table(spark, vectors))) == brute(vectors)


def test_few_vectors_and_none(spark):
    few = [(i, [float(i % 3)] * 64) for i in range(5)]
    assert got(cluster_by_centroids(table(spark, few))) == brute(few)
    assert got(cluster_by_centroids(table(spark, [(1, None)]))) == [] and got(cluster_by_centroids(table(spark, []))) == []


def test_large_components(spark):
    rows = [(i, [(2.0 ** (10 * (i % 7))) * (-1) ** j + i for j in range(64)]) for i in range(30)] + [(77, [1e300] * 64), (78, [-1e300] * 64)]
    assert got(cluster_by_centroids(table(spark, rows))) == brute(rows)


def test_abandoned_centroids_change_nothing():
    rng = np.random.default_rng(2)
    for scale in (3, 1000, 1 << 40):
        x, c = rng.integers(-scale, scale, size=(500, 64)), rng.integers(-scale, scale, size=(8, 64))
        c[5] = c[2]  # a tie everywhere
        label, best = nearest(x, c, rng.permutation(64))
        whole = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert label.tolist() == whole.argmin(axis=1).tolist() and best.tolist() == whole.min(axis=1).tolist()


def test_rounds_end_where_nothing_changes(spark):
    seen = []
    rows = [(i, [float(100 * (i % 4))] * 64) for i in range(40)]
    out = cluster_by_centroids(table(spark, rows), on_round=lambda n, c: seen.append(n))
    assert got(out) == brute(rows) and len(seen) < 10
