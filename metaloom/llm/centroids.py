"""Centroid clustering of integer vectors: a pivot table bounds distances, survivors are exact.

Distances of every vector to fixed pivots are stored once (LAESA). In a round, the
distances of the centroids to the pivots bound every distance of a vector to a centroid from
below: |d(x, p) - d(c, p)| <= d(x, c). A vector visits centroids in the order of their
bounds and computes an integer distance only while the bound does not exceed the best one.

What travels are sums of each task by cluster; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

SIZE = 64
CLUSTERS = 16
ROUNDS = 3
PIVOTS = 8
#: Vectors that pivots are chosen from; they steer the work and not the result.
PIVOT_SAMPLE = 256
#: Components beyond this have squared distances that no long holds.
LARGEST = 1 << 27
#: Bounds are floating point: slack that keeps every centroid in doubt.
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(64 x) of every vector of 64 finite components, 32-bit; null ``v`` beyond ``LARGEST``."""
    x = F.col(column).cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    small = F.forall(x, lambda e: F.abs(64 * e) < LARGEST)
    kept = vectors.where((F.size(x) == SIZE) & whole)
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.when(small, F.transform(x, lambda e: F.floor(64 * e).cast("int"))).alias("v"))


def first_by_hash(table: DataFrame, salt: int, n: int) -> np.ndarray:
    """The n vectors with the smallest sha256 of salt:vec_id, in order; equal ids by their components."""
    ranked = table.where("vec_id is not null and v is not null")
    digest = F.sha2(F.concat_ws(":", F.lit(str(salt)), F.col("vec_id").cast("string")), 256)
    rows = ranked.select(digest.alias("h"), "v").orderBy("h", "v").limit(n).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), SIZE)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of equally many rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n vectors of the sample, each the farthest in sum from those before it."""
    if not len(sample):
        return sample
    chosen, far = [0], np.zeros(len(sample))
    while len(chosen) < min(n, len(sample)):
        far += np.sqrt(squared(sample, sample[chosen[-1]][None, :]).astype(float))
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, SIZE).astype(np.int64)


def _to_pivots(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(1))
        far = np.column_stack([np.sqrt(squared(x, p[None, :]).astype(float)) for p in pivots])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32()), pa.array(far.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "far"])


def nearest(x: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of every row (ties: the smaller number), its squared distance, exact distances computed."""
    rows = np.arange(len(x))
    own = np.column_stack([np.sqrt(squared(centroids, p[None, :]).astype(float)) for p in pivots])
    bound = np.zeros((len(x), len(centroids)))
    for i in range(len(pivots)):
        np.maximum(bound, np.abs(far[:, i : i + 1] - own[None, :, i]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best = order[:, 0].copy()
    distance = squared(x, centroids[best])
    computed = np.ones(len(x), np.int64)
    for rank in range(1, len(centroids)):
        other = order[:, rank]
        reach = np.sqrt(distance.astype(float)) * (1 + SLACK) + SLACK
        open_ = np.flatnonzero(bound[rows, other] * (1 - SLACK) <= reach)
        if not len(open_):
            break
        found = squared(x[open_], centroids[other[open_]])
        computed[open_] += 1
        closer = (found < distance[open_]) | ((found == distance[open_]) & (other[open_] < best[open_]))
        at = open_[closer]
        best[at], distance[at] = other[at], found[closer]
    return best, distance, computed


def _far(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, n)


def _sum(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and component sums of each cluster in the task."""
    sums, counts = np.zeros((len(centroids), SIZE), np.int64), np.zeros(len(centroids), np.int64)
    for batch in batches:
        x = _matrix(batch.column(1))
        best, _, _ = nearest(x, _far(batch.column(2), len(pivots)), centroids, pivots)
        np.add.at(sums, best, x)
        counts += np.bincount(best, minlength=len(centroids))
    held = np.flatnonzero(counts)
    columns = [pa.array(held, pa.int64()), pa.array(counts[held])] + [pa.array(sums[held, i]) for i in range(SIZE)]
    yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *[f"s{i}" for i in range(SIZE)]])


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(1))
        best, distance, computed = nearest(x, _far(batch.column(2), len(pivots)), centroids, pivots)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance), pa.array(computed)], ["vec_id", "cluster", "distance", "compared"]
        )


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The exact floor of the mean of every cluster; an empty one stays."""
    names = [f"s{i}" for i in range(SIZE)]
    shape = ", ".join(f"{c} long" for c in ("cluster", "n", *names))
    sums = table.mapInArrow(partial(_sum, centroids=centroids, pivots=pivots), shape)
    # decimals: sums over very many tasks outgrow a long
    totals = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect()
    out = centroids.copy()
    for r in totals:
        out[r["cluster"]] = [int(r[c]) // r["n"] for c in names]
    return out


def by_cluster(values: list, kind: str) -> Column:
    """The value of the row's cluster."""
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def centroid_clusters(
    spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, salt: int = 1,
    key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, compared, cluster_inertia, inertia, centroid_sha256), one row per kept vector.

    Vectors of another length or with a null or non-finite component are left out; other
    columns are ignored. Centroids start as the vectors of smallest sha256 of salt:vec_id (equal
    ids: by components), all vectors if there are fewer. A null vec_id never starts a centroid
    but is clustered; repeated rows count each. Components of 2^27 and more after scaling have no
    exact squared distance in a long: such a vector keeps its row, with null for the rest. Sums
    beyond a long are null. ``compared`` counts the exact distances of the last round.
    An empty table gives no rows.
    """
    vectors = written(integer_vectors(vectors, key, column), "integer-vectors")
    usable = vectors.where("v is not null")
    centroids = first_by_hash(usable, salt, clusters)
    if not len(centroids):  # no vector with an id: nothing starts a cluster
        centroids = np.zeros((0, SIZE), np.int64)
        assigned = spark.createDataFrame([], "vec_id long, cluster int, distance long, compared long")
        rest = vectors
    else:
        chosen = choose_pivots(first_by_hash(usable, salt + 1, max(PIVOT_SAMPLE, pivots)), pivots)
        table = written(usable.mapInArrow(partial(_to_pivots, pivots=chosen), "vec_id long, v array<int>, far array<double>"), "pivot-table")
        for _ in range(rounds):
            centroids = moved(table, centroids, chosen)
        last = table.mapInArrow(partial(_assign, centroids=centroids, pivots=chosen), "vec_id long, cluster int, distance long, compared long")
        assigned = written(last, "assigned")
        rest = vectors.where("v is null")
    totals = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    inertia = [int(totals.get(i, 0)) for i in range(len(centroids))]

    def as_long(n):
        return n if n < 2**63 else None

    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    found = assigned.select(
        "vec_id", "cluster", "distance", "compared", by_cluster([as_long(n) for n in inertia], "long").alias("cluster_inertia"),
        F.lit(as_long(sum(inertia))).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"),
    )
    nothing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields[1:]}
    return found.unionByName(rest.select("vec_id", *nothing.values()))
