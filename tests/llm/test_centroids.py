"""Ns-bounds clustering against the full search in plain Python."""

import hashlib

import numpy as np
import pytest

from cohortflow.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, id int, v int"


def brute(rows, k=16, rounds=3):
    keep = []
    for vec_id, v, *_ in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            keep.append((vec_id, [int(np.floor(float(np.float32(x)) * 64)) for x in v]))
    h = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(keep, key=lambda r: (h(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for t in range(rounds + 1):
        got = [min((dist(v, m), j) for j, m in enumerate(c)) for _, v in keep]
        if t == rounds:
            break
        for j in range(len(c)):
            mine = [v for (_, v), g in zip(keep, got) if g[1] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = []
    for (i, _), (d, j) in zip(keep, got):
        cap = lambda n: min(n, centroids.LONG_MAX)
        out.append((i, j, cap(d), cap(sum(g[0] for g in got if g[1] == j)), cap(sum(g[0] for g in got)),
                    hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    out = centroids.cluster(df)
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.select(cols).collect()), key=str)


def rows_of(rng, n, centers=6):
    at = rng.normal(size=(centers, 64))
    return [(k, [float(np.float32(x)) for x in at[rng.integers(centers)] + rng.normal(size=64) * 0.4], "x", 1, 2)
            for k in range(n)]


def test_equals_full_search(spark):
    rng = np.random.default_rng(2)
    rows = rows_of(rng, 300)
    rows += [rows[3]] * 100 + [(1000 + k, [0.25] * 64, None, None, None) for k in range(30)]  # repeats and ties
    rows += [(2000, None, "", 0, 0), (2001, [], "", 0, 0), (2002, [1.0] * 63, "", 0, 0), (2003, [1.0] * 65, "", 0, 0),
             (2004, [1.0] * 63 + [None], "", 0, 0), (2005, [1.0] * 63 + [float("nan")], "", 0, 0),
             (2006, [float("-inf")] + [1.0] * 63, "", 0, 0), (None, [0.1] * 64, "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df) == brute(rows)


def test_bounds_spare_most_distances(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(rows_of(rng, 400, 16), SCHEMA)
    full = 400 * 16 * 4
    assert 400 * 16 < centroids.cluster(df).agg({"evaluated": "sum"}).first()[0] < 0.6 * full


def test_bounds_use_the_whole_displacement():
    """A centroid that goes away and comes back loosens nothing, however far it drifted in between."""
    there, away = [[0] * 64, [100] * 64], [[0] * 64, [900] * 64]
    moved = centroids.displacements([there, away, there])
    assert moved[0].tolist() == [0, 0] and moved[1][1] == pytest.approx(6400)
    x = np.full((1, 64), 10)
    state = centroids.first_round(x, np.array(there))
    a, _, _, seen, n = centroids.next_round(x, np.array([there, away, there]), moved, state[0], *state[2:])
    assert a.tolist() == [0] and seen.tolist() == [[2, 0]] and n.tolist() == [3]


def test_few_none_and_huge_vectors(spark):
    rows = rows_of(np.random.default_rng(1), 5)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    big = [(k, [float(k) * 1e6] * 64, "", 0, 0) for k in range(40)]
    assert got(spark.createDataFrame(big, SCHEMA)) == brute(big)
    most = [(k, [3e38 * (-1) ** k] * 64, "", 0, 0) for k in range(20)] + rows
    out = got(spark.createDataFrame(most, SCHEMA))
    assert len(out) == 25 and max(r[2] for r in out) <= centroids.LONG_MAX and min(r[2] for r in out) >= 0
