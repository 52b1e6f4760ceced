"""R-hat and ESS against an independent NumPy implementation of the
published definitions (direct autocovariance sums, no FFT)."""

import math
import statistics

import numpy as np
import pytest

from cohortflow.operators import diagnostics

ND = statistics.NormalDist()


def _split(x):
    n = x.shape[1]
    h = n // 2
    return np.concatenate([x[:, :h], x[:, n - h:]], axis=0)


def _avg_rank(v):
    order = np.argsort(v, kind="mergesort")
    ranks = np.empty(len(v))
    sv = v[order]
    i = 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    return ranks


def _z(x):
    r = _avg_rank(x.ravel()).reshape(x.shape)
    S = x.size
    return np.vectorize(ND.inv_cdf)((r - 0.375) / (S + 0.25))


def _rhat_basic(x):
    m, n = x.shape
    B = n * x.mean(1).var(ddof=1)
    W = x.var(1, ddof=1).mean()
    return math.sqrt((B / W + n - 1) / n)


def np_rhat(x):
    med = np.median(x)
    return max(_rhat_basic(_z(_split(x))), _rhat_basic(_z(_split(np.abs(x - med)))))


def _ess(x):
    m, n = x.shape
    ac = []
    for row in x:
        c = row - row.mean()
        ac.append([np.dot(c[:n - t], c[t:]) / n for t in range(n)])
    ac = np.array(ac)
    mean_var = ac[:, 0].mean() * n / (n - 1)
    var_plus = mean_var * (n - 1) / n + (x.mean(1).var(ddof=1) if m > 1 else 0.0)
    rho = 1 - (mean_var - ac.mean(0)) / var_plus
    r = np.zeros(n)
    t, even, odd = 0, 1.0, rho[1]
    r[0], r[1] = even, odd
    while t < n - 5 and not math.isnan(even + odd) and even + odd > 0:
        t += 2
        even, odd = rho[t], rho[t + 1]
        if even + odd >= 0:
            r[t], r[t + 1] = even, odd
    max_t = t
    if even > 0:
        r[max_t] = even
    t = 0
    while t <= max_t - 4:
        t += 2
        if r[t] + r[t + 1] > r[t - 2] + r[t - 1]:
            r[t] = (r[t - 2] + r[t - 1]) / 2
            r[t + 1] = r[t]
    S = m * n
    tau = max(-1 + 2 * r[:max_t].sum() + r[max_t], 1 / math.log10(S))
    return S / tau


def np_ess_bulk(x):
    return _ess(_z(_split(x)))


def np_ess_tail(x):
    out = []
    for p in (0.05, 0.95):
        q = np.quantile(x, p)   # type 7
        out.append(_ess(_split((x <= q).astype(float))))
    return min(out)


def _draws(spark, arrays):
    rows = []
    for name, x in arrays.items():
        for c in range(x.shape[0]):
            for i in range(x.shape[1]):
                rows.append(("r", name, c + 1, i + 1, float(x[c, i])))
    return spark.createDataFrame(rows, "run_id string, variable string, chain int, iteration int, value double")


def test_rhat_ess_match_numpy(spark):
    rng = np.random.default_rng(7)
    ar = np.zeros((4, 101))
    e = rng.normal(size=(4, 101))
    for i in range(1, 101):
        ar[:, i] = 0.7 * ar[:, i - 1] + e[:, i]          # autocorrelated chains
    arrays = {
        "a[1]": rng.normal(size=(4, 100)),
        "b[1,2]": ar,                                     # odd length: middle draw skipped
        "c": rng.normal(size=(4, 60)) + np.array([[0.0], [0.0], [0.5], [1.0]]),  # chains disagree
        "d": np.round(rng.normal(size=(4, 80)), 1),      # many ties
    }
    conv = {r.variable: r for r in diagnostics.convergence(_draws(spark, arrays)).collect()}
    for name, x in arrays.items():
        assert conv[name].rhat == pytest.approx(np_rhat(x), rel=1e-9), name
        assert conv[name].ess_bulk == pytest.approx(np_ess_bulk(x), rel=1e-7), name
        assert conv[name].ess_tail == pytest.approx(np_ess_tail(x), rel=1e-7), name


def test_constant_variable_gives_null(spark):
    arrays = {"surv[1,21]": np.zeros((4, 50)), "x": np.random.default_rng(1).normal(size=(4, 50))}
    conv = {r.variable: r for r in diagnostics.convergence(_draws(spark, arrays)).collect()}
    assert conv["surv[1,21]"].rhat is None
    assert conv["surv[1,21]"].ess_bulk is None and conv["surv[1,21]"].ess_tail is None
    assert conv["x"].rhat is not None
