"""Sparse Leslie products, binning by a table of edges, log-gamma and the Dirichlet prior."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions.scalar import bin_lower_edge, log_gamma
from cohortflow.operators import intervals, leslie, scoring
from tests.test_cohort import _frame, _leslie


def matrices(spark, T=6, K=5):
    out, dense = None, {}
    for k in range(3):
        df, surv, fert, pop0 = _frame(spark, T=T, K=K, seed=k)
        row = df.withColumn("draw", F.lit(k))
        out = row if out is None else out.unionByName(row)
        reprod = df.select("reprod").first()[0]
        dense[k] = [_leslie(np.array(s), np.array(r)) for s, r in zip(surv, reprod)], np.array(pop0)
    return out, dense


def as_dense(rows, K):
    m = np.zeros((K, K))
    for r in rows:
        m[r.row - 1, r.col - 1] = r.value
    return m


@pytest.mark.parametrize("periods", [1, 3, 4, 6])
def test_products_equal_dense(spark, periods):
    df, dense = matrices(spark)
    got = leslie.product(leslie.triplets(df, ["draw"]), ["draw"], periods).collect()
    for k, (ms, _) in dense.items():
        for t0 in range(0, 6, periods):
            want = np.eye(5)
            for m in ms[t0:t0 + periods]:
                want = m @ want
            assert np.allclose(as_dense([r for r in got if r.draw == k and r.t0 == t0], 5), want)


def test_product_moves_its_entries_once(spark):
    """One shuffle for all steps, no copy of the entries in between; a block without a neighbour keeps repeated entries."""
    rows = [(1, 1, 1, 1, 2.0), (1, 1, 1, 2, 3.0), (1, 2, 1, 1, 5.0), (1, 2, 2, 1, 7.0), (1, 3, 1, 2, 0.5), (1, 3, 1, 2, 0.5), (1, 3, 2, 2, None)]
    m = spark.createDataFrame(rows, "k int, t int, row int, col int, value double")
    out = leslie.product(m, ["k"], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = sorted(((r.t0, r.row, r.col, r.value) for r in out.collect()), key=str)
    assert got == [(0, 1, 1, 10.0), (0, 1, 2, 15.0), (0, 2, 1, 14.0), (0, 2, 2, 21.0), (2, 1, 2, 0.5), (2, 1, 2, 0.5), (2, 2, 2, None)]


def test_projection_and_no_births(spark):
    df, dense = matrices(spark)
    m = leslie.triplets(df, ["draw"])
    start = df.select("draw", F.posexplode("pop0").alias("a", "value")).withColumn("a", F.col("a") + 1)
    got = {(r.draw, r.t, r.a): r.value for r in leslie.project(m, start, ["draw"], 6).collect()}
    for k, (ms, pop) in dense.items():
        for t in range(1, 7):
            pop = pop if t == 1 else ms[t - 2] @ pop
            assert np.allclose([got[k, t, a] for a in range(1, 6)], pop)
    none = leslie.triplets(df, ["draw"], births=False)
    assert none.where("row = 1").isEmpty() and none.count() == 3 * 6 * 5
    holes = df.withColumn("surv", F.when(F.col("draw") > 0, F.col("surv")))
    assert {r.draw for r in leslie.triplets(holes, ["draw"]).where("row > 1 and value is not null").collect()} == {1, 2}


def test_null_entry_makes_its_sum_null(spark):
    m = spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 2, None), (1, 2, 1, 3.0)], "k int, row int, col int, value double")
    v = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0)], "k int, a int, value double")
    assert {r.a: r.value for r in leslie.times_vector(m, v, ["k"]).collect()} == {1: None, 2: 15.0}


def test_edges_as_a_table(spark):
    inf = float("inf")
    edges = {"a": [0.0, 5.0, 10.0, 50.0, inf], "b": [-inf, 20.0, 21.0, 100.0], "c": [3.0], "d": [1.0, 1.0, 4.0], "e": [-inf, inf]}
    e = spark.createDataFrame([(k, x) for k, xs in edges.items() for x in xs] + [("a", None)], "k string, edge double")
    values = [-1e9, -1.0, 0.0, 1.0, 3.9, 4.0, 4.999, 5.0, 9.0, 20.0, 20.5, 21.0, 49.0, 50.0, 100.0, 101.0, 1e9, inf, -inf, float("nan"), None]
    df = spark.createDataFrame([(k, x) for k in [*edges, "none", None] for x in values], "k string, x double")
    for closed in (True, False):
        got = intervals.bin_by_table(df, e, ["k"], "x", closed_last=closed)
        assert got.columns == ["k", "x", "bin"]
        rows = [(r.k, r.x, r.bin) for r in got.collect()]
        assert len(rows) == len(values) * 7
        for k, x, b in rows:
            es, want = sorted(set(edges.get(k, []))), None
            if x is not None and x == x:
                for lo, hi in zip(es, es[1:]):
                    if lo <= x < hi or (closed and hi == es[-1] and x == hi):
                        want = lo
            assert b == want, (k, x, b, want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # the same as the array form where the edges are one array
    one = df.where("k = 'a' and x is not null and not isnan(x)")
    both = intervals.bin_by_table(one, e, ["k"], "x").withColumn("w", bin_lower_edge("x", edges["a"])).collect()
    assert all(r.bin == r.w for r in both)


def test_log_gamma(spark):
    xs = [1e-8, 0.01, 0.3, 0.5, 1.0, 1.5, 2.0, 10.0, 33.3, 500.0, 1e5, 1e9]
    df = spark.createDataFrame([(x,) for x in [*xs, 0.0, -1.0, None]], "x double")
    got = {r.x: r.g for r in df.select("x", log_gamma("x").alias("g")).collect()}
    for x in xs:
        assert got[x] == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)
    assert got[0.0] == math.inf and got[-1.0] is None and got[None] is None


def test_dirichlet_prior_of_a_profile(spark):
    rows = [([1.5, 20.0, 300.0], [0.01, 0.04, 0.6]), ([1.5, -2.0, 3.0], [0.1, 0.2, 0.7]), ([1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "g array<double>, p array<double>")
    got = [r[0] for r in df.select(scoring.dirichlet_log_prior("g", "p", 500)).collect()]
    want = sum((500 * p - 1) * math.log(g) - g - math.lgamma(500 * p) for g, p in zip(*rows[0]))
    assert got[0] == pytest.approx(want, rel=1e-12) and got[1] == -math.inf and got[2] is None


def test_models_have_their_own_scales(spark):
    """Expected values written from the models' text: scale 0.07 and 0.05 in one, 1 and 10 in the others."""
    from cohortflow.plans.queries import MODEL_PRIORS
    half = lambda x, s: math.log(2) - 0.5 * math.log(2 * math.pi) - math.log(s) - 0.5 * (x / s) ** 2
    d = spark.createDataFrame([("sigma_surv", 1, 1, 0.1), ("sigma_fert", 1, 1, 0.2), ("sigma_pop", 1, 1, 3.0),
                               ("other[1]", 1, 1, 9.0)], "variable string, chain int, iteration int, value double")
    got = {r.model: (r.log_prior, r.n_terms) for r in scoring.score_models(
        d, scoring.model_specs(spark, MODEL_PRIORS), ["chain", "iteration"]).collect()}
    want = {"disaggregated": (half(0.1, 0.07) + half(0.2, 0.05), 2), "dirichlet_init": (half(0.1, 1) + half(0.2, 1) + half(3, 10), 3),
            "lognormal_init": (half(0.1, 10) + half(0.2, 10) + half(3, 10), 3),
            "lognormal_obs": (half(0.1, 10) + half(0.2, 10) + half(3, 1), 3),
            "uniform_init": (half(0.1, 10) + half(0.2, 10) + half(3, 10), 3)}
    assert set(got) == set(want)
    for m, (x, n) in want.items():
        assert got[m] == (pytest.approx(x), n)
