"""What an operator cannot use is reported, never dropped in silence."""

import math

import numpy as np
import pytest

from cohortflow.operators import diagnostics, scoring, survey


def test_unequal_chains_give_null_and_are_listed(spark):
    rng = np.random.default_rng(1)
    rows = [("r", "x", c, i, float(rng.normal())) for c, n in ((1, 100), (2, 40)) for i in range(n)]
    rows += [("r", "y", c, i, float(rng.normal())) for c in (1, 2) for i in range(50)]
    d = spark.createDataFrame(rows, "run_id string, variable string, chain int, iteration int, value double")
    out = {r.variable: r for r in diagnostics.convergence(d).collect()}
    assert out["x"].rhat is None and out["x"].ess_bulk is None and out["x"].ess_tail is None
    assert out["y"].rhat is not None and out["y"].ess_bulk > 0
    assert [tuple(r) for r in diagnostics.unequal_chains(d).collect()] == [("r", "x", 40, 100)]


def test_priors_out_of_support_and_unmatched(spark):
    rows = [("a", 1, 1, 0.5), ("s", 1, 1, -1.0), ("g[1]", 1, 1, 2.0), ("g[2]", 1, 1, 3.0), ("z[1]", 1, 1, 9.0),
            ("a", 1, 2, 0.5), ("s", 1, 2, 1.0), ("g[1]", 1, 2, 2.0), ("g[2]", 1, 2, 3.0), ("z[1]", 1, 2, 9.0)]
    d = spark.createDataFrame(rows, "variable string, chain int, iteration int, value double")
    spec = scoring.prior_spec(spark, [("a", "normal", 0, 1), ("s", "half_normal", 0, 2), ("g", "gamma", 2, 1),
                                      ("g[2]", "gamma", 5, 1)])
    out = {r.iteration: r for r in scoring.score_priors(d, spec, by=["chain", "iteration"]).collect()}
    assert out[1].log_prior == -math.inf and out[1].n_terms == 4
    gamma = lambda x, a: (a - 1) * math.log(x) - x - math.lgamma(a)
    half = math.log(2) - 0.5 * math.log(2 * math.pi) - math.log(2) - 0.125
    normal = -0.5 * math.log(2 * math.pi) - 0.125
    assert out[2].log_prior == pytest.approx(normal + half + gamma(2, 2) + gamma(3, 5))
    assert [tuple(r) for r in scoring.unmatched_parameters(d, spec).collect()] == [("z", 2)]
    bad = spark.createDataFrame([(0.0,), (-1.0,)], "x double")
    assert all(r[0] == r[1] == -math.inf for r in bad.select(
        scoring.lognormal_lpdf("x", bad.x * 0, bad.x * 0 + 1), scoring.gamma_lpdf("x", bad.x * 0 + 2, bad.x * 0)).collect())


def test_out_of_edge_persons_and_empty_groups(spark):
    rows = [("A", 2, 34.0, 1967.0, 3.0, 0), ("A", 2, 20.0, 1949.0, 1.0, 0), ("A", 2, -1.0, 1930.0, 1.0, 0),
            ("A", 2, -1.0, None, None, 1), ("B", 1, 30.0, 1967.0, 2.0, 0)]
    p = spark.createDataFrame(rows, "region string, basic_gender int, basic_age double, year_migration_m double, "
                                    "age_migration_m double, born_kenya_m int")
    cells = spark.createDataFrame([(y, a) for y in (1950, 1955, 1960, 1965) for a in (0, 5, 30)], "year int, age int")
    axes = survey.axes_from_rates(cells)
    grid = survey.count_cohort_age(p, axes, by=["region"]).collect()
    assert len(grid) == 24 and sum(r.n for r in grid) == 1  # region B keeps its 0-filled grid
    got = {(r["table"], r.reason): r.n for r in survey.dropped_counts(p, axes).collect()}
    assert got == {("cohort_age", "year"): 1, ("cohort_age", "both"): 1, ("native_age", "age"): 1}


def test_replayed_batch_is_not_written_twice(spark, tmp_path):
    from cohortflow.streaming import ingest
    d = spark.createDataFrame([("s", "x", 1, 1, 0.5), ("s", "x", 1, 2, 0.6)], ingest.DRAWS_SCHEMA)
    for batch in (0, 1, 1):
        ingest.write_draws_batch(d, batch, str(tmp_path), "one")
    assert spark.read.parquet(str(tmp_path / "draws")).count() == 4


def test_wide_grid_needs_a_shared_folder_on_a_cluster():
    from unittest import mock

    from cohortflow import session
    spark = mock.Mock()
    spark.conf.get.return_value = None
    spark.sparkContext.getCheckpointDir.return_value = None
    spark.sparkContext.master = "yarn"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)
