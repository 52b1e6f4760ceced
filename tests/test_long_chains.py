"""Ranks, R-hat and ESS without a task per variable, against the windows and the FFT."""

import numpy as np
import pytest

from cohortflow.operators import diagnostics, draws, long_chains


@pytest.fixture(autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def frame(spark, series):
    rows = [("r", v, c, i, float(x)) for (v, c), xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "run_id string, variable string, chain int, iteration int, value double")


def test_mean_ranks_with_ties_over_borders(spark):
    rng = np.random.default_rng(1)
    xs = rng.integers(0, 40, 3000)
    df = frame(spark, {("a", 1): xs, ("b", 1): np.arange(50)})
    got = {(r.variable, r.value): (r["rank"], r["size"]) for r in long_chains.mean_ranks(df, ["variable"], "value").collect()}
    for v in range(40):
        below, same = (xs < v).sum(), (xs == v).sum()
        assert got["a", float(v)] == (below + (same + 1) / 2, 3000)
    assert got["b", 49.0] == (50.0, 50)


def test_convergence_equals_windows_and_fft(spark, monkeypatch):
    rng = np.random.default_rng(3)
    slow = lambda n, rho: np.array([x for x in _ar(rng, n, rho)])
    series = {("noise", c): rng.normal(size=301) for c in (1, 2)} | {("slow", c): slow(301, 0.97) + c for c in (1, 2)}
    series |= {("ties", c): rng.integers(0, 3, 301) for c in (1, 2)} | {("const", c): np.ones(40) for c in (1, 2)}
    series |= {("uneven", 1): rng.normal(size=100), ("uneven", 2): rng.normal(size=60)}
    series |= {("nan", c): [float("nan")] + list(rng.normal(size=39)) for c in (1, 2)} | {("short", 1): [1.0, 2.0, 4.0, 3.0]}
    df = frame(spark, series)
    z = long_chains.normalised(df)
    got = {r.variable: r for r in diagnostics.rhat(df, normalised=z).join(
        long_chains.ess(z, ["run_id", "variable"], segment=40, first_lags=4), ["run_id", "variable"], "left").collect()}
    want = {r.variable: r for r in diagnostics.convergence(df).collect()}
    assert set(got) == set(want)
    for v, w in want.items():
        for c in ("rhat", "ess_bulk", "ess_tail"):
            assert got[v][c] == (None if w[c] is None else pytest.approx(w[c], rel=1e-9)), (v, c)


def _ar(rng, n, rho):
    x = 0.0
    for _ in range(n):
        x = rho * x + rng.normal()
        yield x


@pytest.mark.parametrize("segment,lags", [(7, 3), (50, 20), (1000, 99)])
def test_segments_add_up_to_the_chain(segment, lags):
    x = np.random.default_rng(2).normal(size=100)
    total = np.zeros(lags + 1)
    for at in range(0, 100, segment):
        total += long_chains.segment_products(x[at:at + segment + lags], min(segment, 100 - at), lags)
    assert np.allclose(total, [np.dot(x[:100 - k], x[k:]) for k in range(lags + 1)])


def test_no_window_over_a_variable(spark):
    """Windows are over parts of a variable (a partition's rows, or the parts' totals), never over its draws."""
    rng = np.random.default_rng(4)
    df = frame(spark, {("v", 1): rng.normal(size=500)})
    p = long_chains.mean_ranks(df, ["variable"], "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in p.replace("windowspecdefinition(variable", "").split("Aggregate")[0] or "_p" in p


def test_quantiles_refined_to_a_bound(spark):
    rng = np.random.default_rng(5)
    series = {("many", 1): rng.normal(size=4000), ("few", 1): rng.integers(0, 3, 4000), ("one", 1): np.full(300, 2.5),
              ("heavy", 1): np.concatenate([np.zeros(3000), rng.normal(size=1000)]), ("tiny", 1): [3.0]}
    df = frame(spark, series)
    probs = (0.0, 0.025, 0.3, 0.5, 0.9, 1.0)
    # a coarse sketch and a small bound: several rounds of refining
    got = {r.variable: r for r in draws.bracketed_quantiles(df, ["variable"], probs, accuracy=30, bound=9).collect()}
    for (v, _), xs in series.items():
        for p in probs:
            assert got[v][draws.quantile_name(p)] == pytest.approx(np.quantile(xs, p), abs=1e-12), (v, p)
