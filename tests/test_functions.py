import statistics

import pytest
from pyspark.sql import functions as F

from cohortflow.functions.scalar import (bin_lower_edge, inv_logit, leading_number, logit, norm_ppf,
                                         softmax, to_number)


def test_leading_number_and_to_number(spark):
    df = spark.createDataFrame([("1950-1955",), ("100+",), ("15-19",), ("x",), (None,)], "s string")
    got = df.select(leading_number("s").alias("n"), to_number("s").alias("t")).collect()
    assert [r.n for r in got] == [1950.0, 100.0, 15.0, None, None]
    assert all(r.t is None for r in got)


def test_bin_lower_edge_edges(spark):
    # FIXTURES registrations: 1967 -> 1965; 1970 (edge, lower closed) -> 1970;
    # 2030 (last edge, closed) -> 2025; 1949 (before first edge) -> NULL; 2031 -> NULL
    edges = [1950.0 + 5 * i for i in range(17)]
    df = spark.createDataFrame([(1967.0,), (1970.0,), (2030.0,), (1949.0,), (2031.0,)], "x double")
    got = [r[0] for r in df.select(bin_lower_edge("x", edges)).collect()]
    assert got == [1965.0, 1970.0, 2025.0, None, None]


def test_bin_open_top(spark):
    edges = [0.0, 5.0, 10.0, float("inf")]
    df = spark.createDataFrame([(34.0,), (101.0,), (0.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(bin_lower_edge("x", edges)).collect()] == [10.0, 10.0, 0.0, None]


def test_norm_ppf_matches_stdlib(spark):
    ps = [1e-12, 0.001, 0.02, 0.3, 0.5, 0.77, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(norm_ppf("p")).collect()]
    nd = statistics.NormalDist()
    for p, g in zip(ps, got):
        assert g == pytest.approx(nd.inv_cdf(p), abs=1e-12)
    edge = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(norm_ppf("p")).collect()
    assert [r[0] for r in edge] == [None, None]


def test_links_and_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 0.25)], "a array<double>, p double")
    r = df.select(softmax("a").alias("s"), inv_logit(logit("p")).alias("q")).collect()[0]
    assert sum(r.s) == pytest.approx(1.0)
    assert r.s[2] > r.s[1] > r.s[0]
    assert r.q == pytest.approx(0.25)
