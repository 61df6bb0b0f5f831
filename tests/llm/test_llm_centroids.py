"""Clusters against brute force with exact integers; what the pivots save."""

import hashlib
import math
import random

import numpy as np
import pytest

from metaloom.llm import centroids

SHAPE = "vec_id long, embedding array<float>, label int, v string, far string, cluster string, distance string"


def rows_of(rng, n, spread=1.0):
    middles = [[rng.uniform(-3, 3) for _ in range(64)] for _ in range(9)]
    return [(i, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(middles)], 1, "v", "f", "c", "d") for i in range(n)]


def brute(rows, k=16, rounds=3, salt=1):
    kept = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
    usable = [(i, v) for i, v in kept if max(map(abs, v)) < 1 << 27]
    start = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in usable if i is not None)[:k]
    middle = [v for _, v in start]

    def assign():
        out = []
        for i, v in usable:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(middle)):
            own = [v for _, v, x, _ in found if x == c]
            if own:
                middle[c] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    total = [sum(d for _, _, x, d in found if x == c) for c in range(len(middle))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    out = [(i, c, d, total[c], sum(total), sha[c]) for i, _, c, d in found]
    return out + [(i, None, None, None, None, None) for i, v in kept if max(map(abs, v)) >= 1 << 27]


def result(spark, rows, **kw):
    found = centroids.centroid_clusters(spark, spark.createDataFrame(rows, SHAPE), **kw)
    return [(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found.collect()]


def same(a, b):
    key = lambda t: tuple((x is None, x) if x is not None else (True, 0) for x in t)
    return sorted(a, key=key) == sorted(b, key=key)


def test_equals_brute_force(spark):
    rows = rows_of(random.Random(2), 300)
    assert same(result(spark, rows), brute(rows))


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 60)
    tie = [0.0] * 64
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [3e9] * 64, [-1e38] + [0.0] * 63]
    rows += [(1000 + i, e, None, None, None, None, None) for i, e in enumerate(bad)]
    rows += [(5, tie, 1, "", "", "", ""), (5, tie, 1, "", "", "", ""), (7, [-0.001] * 64, 1, "", "", "", ""), (None, [0.5] * 64, 1, "", "", "", "")]
    assert same(result(spark, rows), brute(rows))


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_vectors_than_centroids(spark, n):
    rows = rows_of(random.Random(4), n)
    assert same(result(spark, rows), brute(rows))


def test_empty_table_and_no_ids(spark):
    assert result(spark, []) == []
    rows = [(None, [1.0] * 64, 1, "", "", "", "")]
    assert result(spark, rows) == [(None, None, None, None, None, None)]


def test_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [1.0] * 64, 1, "", "", "", "") for i in range(40)] + [(99, [2.0] * 64, 1, "", "", "", "")]
    assert same(result(spark, rows), brute(rows))


def test_bounds_prune_and_never_lie():
    rng = np.random.default_rng(7)
    middle = rng.integers(-4000, 4000, (16, 64))
    x = (middle[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 64))).astype(np.int64)
    cents = middle.astype(np.int64)
    pivots = centroids.choose_pivots(x[:256], 8)
    far = np.column_stack([np.sqrt(centroids.squared(x, p[None, :]).astype(float)) for p in pivots])
    best, distance, compared = centroids.nearest(x, far, cents, pivots)
    full = np.stack([centroids.squared(x, c[None, :]) for c in cents], axis=1)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert compared.mean() < 3


def test_partitions_do_not_matter(spark):
    rows = rows_of(random.Random(5), 120)
    df = spark.createDataFrame(rows, SHAPE)
    out = [sorted(map(tuple, centroids.centroid_clusters(spark, df.repartition(n)).collect())) for n in (1, 5, 13)]
    assert out[0] == out[1] == out[2]
