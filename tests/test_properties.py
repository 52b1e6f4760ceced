"""Seeded property tests (hypothesis) for binning, band spreading and quantiles."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortflow.functions.scalar import bin_lower_edge
from cohortflow.operators import draws, survey

SETTINGS = settings(max_examples=8, deadline=None, derandomize=True)


@SETTINGS
@given(st.lists(st.floats(min_value=-10, max_value=120, allow_nan=False), min_size=1, max_size=40),
       st.integers(min_value=1, max_value=10))
def test_bin_matches_searchsorted(spark, xs, step):
    edges = [float(e) for e in range(0, 100 + step, step)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r[0] for r in df.select(bin_lower_edge("x", edges)).collect()]
    e = np.array(edges)
    for x, g in zip(xs, got):
        if x < e[0] or x > e[-1]:
            assert g is None
        else:
            i = min(np.searchsorted(e, x, side="right") - 1, len(e) - 2)
            assert g == e[i]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30), st.integers(1, 500)), min_size=1, max_size=12))
def test_spread_conserves_counts(spark, bands):
    rows = [(f"{lo}-{lo + width}", float(n)) for lo, width, n in bands]
    df = spark.createDataFrame(rows, "age_member string, n double")
    out = survey.spread_bands(df, "age_member").collect()
    assert abs(sum(r.n for r in out) - sum(n for _, n in rows)) < 1e-6
    assert len(out) == sum(width for _, width, _ in bands)


@SETTINGS
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=2, max_size=60))
def test_quantiles_type7(spark, vals):
    rows = [("r", "x", 1, i, float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "run_id string, variable string, chain int, iteration int, value double")
    s = draws.summarise_draws(df).collect()[0]
    for p in draws.DEFAULT_PROBS:
        assert np.isclose(s[draws.quantile_name(p)], np.quantile(vals, p), rtol=1e-9, atol=1e-6)
