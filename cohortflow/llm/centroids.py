"""Exact k-means on integer vectors with ns-bounds.

A vector keeps, per centroid, a lower bound: its distance when that pair was
last evaluated, and the round of that evaluation. All rounds' centroids are
retained, so a stored bound is loosened by the norm of the centroid's whole
displacement since then (which is at most the sum of the per-round drifts).
The distance to the vector's own centroid is always taken anew; a pair whose
loosened bound doesn't exceed it fails the test and is rescanned exactly.
Bounds are rounded outwards, distances are integers: the result is that of
the full search.

Vectors never move: a round maps over the state in place, writes the new
state to the shared folder (the one before is deleted then), and only the
clusters' partial sums, one row per task, cluster and component, are
shuffled. A cluster that holds all vectors is no hot key.

Defined results: vectors of another length, and those with a null or
non-finite component, are left out, null vectors too. A component beyond a
long counts as its end; a distance or sum beyond a long is given as its
greatest value. Vectors without id come last in the choice of the first
centroids, equal hashes are ordered by components, repeated rows are vectors
of their own. With fewer vectors than centroids there are fewer of these; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_folder, ensure_checkpoint_dir
from .common import settled, ship

K, ROUNDS, SCALE, DIMS = 16, 3, 64, 64
LONG_MAX = 2 ** 63 - 1
# below it, the squared distance of two vectors of up to 64 components fits in 64 bits
SAFE = 1 << 27
STATE = "id {id}, v array<bigint>, cluster int, distance bigint, lower array<float>, seen array<int>, evaluated int"


def scaled(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def kept(df: DataFrame, id: str, vector: str, scale: int, dims: int) -> DataFrame:
    """(id, v): the vectors of the right length without null or non-finite components, as integers."""
    v = F.col(f"`{vector}`")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter((F.size(v) == dims) & fit).select(F.col(f"`{id}`").alias("id"), scaled(v, scale).alias("v"))


def starts(vectors: DataFrame, k: int) -> list[list[int]]:
    """The vectors with the smallest hash of ``1:<id>``; at most ``k`` rows reach the driver."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as 64-bit integers where they are sure to fit, else as Python's."""
    small = all(int(m) < SAFE for a in (x, c) if a.size for m in (a.max(), -int(a.min())))
    if not (small and x.shape[-1] <= DIMS):
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=-1)


def _down(d: np.ndarray) -> np.ndarray:
    """Distances as floats that are never above the true ones."""
    return (np.sqrt(d.astype(np.float64)) * (1 - 1e-6)).astype(np.float32)


def displacements(history: list[list[list[int]]]) -> np.ndarray:
    """Per round and centroid, how far it now is from where it was then; never below the true norm."""
    now = history[-1]
    return np.array([[math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q))) * (1 + 1e-9) for p, q in zip(then, now)]
                     for then in history])


def first_round(x: np.ndarray, centroids: np.ndarray):
    d = np.stack([exact(x, c) for c in centroids], axis=1)
    a = d.argmin(axis=1)
    n = np.full(len(x), len(centroids), np.int32)
    return a, d[np.arange(len(x)), a], _down(d), np.zeros(d.shape, np.int32), n


def next_round(x, history, moved, a, lower, seen, evaluated):
    """Assignment by the last centroids of ``history``; bounds that hold spare their pair the distance."""
    t, rows, now = len(history) - 1, np.arange(len(x)), history[-1]
    best, best_d = a.copy(), exact(x, now[a])
    lower, seen = lower.copy(), seen.copy()
    lower[rows, a], seen[rows, a] = _down(best_d), t
    loose = lower.astype(np.float64) - moved[seen, np.arange(len(now))]
    fails = loose <= (np.sqrt(best_d.astype(np.float64)) * (1 + 1e-9))[:, None]
    fails[rows, a] = False
    for k in np.flatnonzero(fails.any(axis=0)):
        i = np.flatnonzero(fails[:, k])
        d = exact(x[i], now[k])
        lower[i, k], seen[i, k] = _down(d), t
        nearer = (d < best_d[i]) | ((d == best_d[i]) & (k < best[i]))
        best[i[nearer]], best_d[i[nearer]] = k, d[nearer]
    return best, best_d, lower, seen, evaluated + 1 + fails.sum(axis=1).astype(np.int32)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _list(values: np.ndarray, kind) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32), pa.array(values.ravel(), kind))


def _assigner(history: list[list[list[int]]], dims: int):
    """A map over state batches; the centroids of all rounds travel with it (their number is bounded by parameters)."""
    first, k = len(history) == 1, len(history[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.array(history, dtype=np.int64)
        moved = displacements(history)
        for b in batches:
            x = _matrix(b.column("v"), dims)
            if first:
                a, d, lower, seen, n = first_round(x, h[0])
            else:
                a, d, lower, seen, n = next_round(
                    x, h, moved, b.column("cluster").to_numpy(), _matrix(b.column("lower"), k),
                    _matrix(b.column("seen"), k), b.column("evaluated").to_numpy())
            d = np.minimum(d, LONG_MAX).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(a.astype(np.int32)), pa.array(d), _list(lower, pa.float32()),
                 _list(seen, pa.int32()), pa.array(n)],
                names=["id", "v", "cluster", "distance", "lower", "seen", "evaluated"])

    return run


def _partial_sums(k: int, dims: int):
    """Per task: each cluster's number of vectors and sum of every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * k, [[0] * dims for _ in range(k)]
        for b in batches:
            x, a = _matrix(b.column("v"), dims), b.column("cluster").to_numpy()
            if x.size and max(int(x.max()), -int(x.min())) > SAFE:
                x = x.astype(object)
            for c in np.unique(a):
                part = x[a == c]
                count[c] += len(part)
                total[c] = [s + int(p) for s, p in zip(total[c], part.sum(axis=0))]
        used = [(c, i) for c in range(k) if count[c] for i in range(dims)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in used], pa.int32()), pa.array([i for _, i in used], pa.int32()),
             pa.array([count[c] for c, _ in used], pa.int64()),
             pa.array([total[c][i] for c, i in used], pa.decimal128(38, 0))], names=["cluster", "i", "n", "s"])

    return run


def moved_centroids(state: DataFrame, before: list[list[int]], dims: int) -> list[list[int]]:
    """Floor of the exact mean of every cluster; an empty one keeps its centroid. Clusters x components rows are collected."""
    sums = state.select("v", "cluster").mapInArrow(_partial_sums(len(before), dims),
                                                   "cluster int, i int, n bigint, s decimal(38,0)")
    now = [list(c) for c in before]
    for r in sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        now[r.cluster][r.i] = int(r.s) // r.n
    return now


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS,
            scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """Per kept vector: id, cluster, squared distance, evaluated (exact distances taken for it in all rounds),
    cluster_inertia, inertia and centroid_sha256."""
    spark = df.sparkSession
    vectors = kept(df, id, vector, scale, dims)
    kind = vectors.schema["id"].dataType.simpleString()
    schema = STATE.format(id=kind)
    history = [starts(vectors, k)]
    if not history[0]:
        empty = spark.createDataFrame([], f"cluster int, distance bigint, evaluated int, cluster_inertia bigint, "
                                          f"inertia bigint, centroid_sha256 string")
        return empty.select(F.lit(None).cast(kind).alias(id), "*")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/centroids-{uuid.uuid4().hex}"
    state, last = vectors, None
    for t in range(rounds):
        path = f"{folder}/{t}"
        state.mapInArrow(_assigner(history, dims), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if last:
            drop_folder(spark, last)
        last = path
        history.append(moved_centroids(state, history[-1], dims))
    done = settled(state.mapInArrow(_assigner(history, dims), schema).select("id", "cluster", "distance", "evaluated"))
    drop_folder(spark, folder)
    per = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    fit = lambda n: min(int(n), LONG_MAX)
    rows = [(r.cluster, fit(r.s), fit(sum(p.s for p in per)), digest(history[-1][r.cluster])) for r in per]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # at most k rows
    return done.join(F.broadcast(stats), "cluster").select(
        F.col("id").alias(id), "cluster", "distance", "evaluated", "cluster_inertia", "inertia", "centroid_sha256")


ship(__name__)
