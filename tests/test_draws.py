import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import draws, reports


def _d(spark, rows):
    return spark.createDataFrame(rows, "run_id string, variable string, chain int, iteration int, value double")


def test_quantiles_type7_and_nulls(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=37)
    rows = [("r", "x", 1 + i % 4, i, float(v)) for i, v in enumerate(vals)] + [("r", "x", 1, 99, None)]
    s = draws.summarise_draws(_d(spark, rows)).collect()[0]
    for p in draws.DEFAULT_PROBS:
        assert s[draws.quantile_name(p)] == pytest.approx(np.quantile(vals, p), rel=1e-12)
    assert s.mean == pytest.approx(vals.mean())
    assert s.sd == pytest.approx(vals.std(ddof=1))


def test_extract_indexed_rules(spark):
    rows = []
    for name in ["fert[2,11]", "fert_sub[2,4]", "pop_mig_true[1,4,7]", "pop_0_x[1,2]", "lp__",
                 "total_pop[3]", "total_mig_pop[3]"]:
        rows.append(("r", name, 1, 1, 1.0))
    s = draws.summarise_draws(_d(spark, rows), probs=(0.5,))
    year = spark.createDataFrame([(1, 1950), (2, 1955), (3, 1960), (4, 1965)], "number int, value int")
    age = spark.createDataFrame([(i, 5 * (i - 1)) for i in range(1, 12)], "number int, value int")
    f = draws.extract_indexed(s, "fert", mappings=[("year", year), ("age", age)]).collect()
    assert [(r.year, r.age) for r in f] == [(1955, 50)]                 # fert_sub not matched
    p = draws.extract_indexed(s, "pop_0_x", indices=["a", "b"]).collect()
    assert [(r.a, r.b) for r in p] == [(1, 2)]                           # digit in the name ignored
    m = draws.extract_indexed(s, "pop_mig_true", mappings=[("m", year), ("t", year), ("age", age)]).collect()
    assert [(r.m, r.t, r.age) for r in m] == [(1950, 1965, 30)]
    t = draws.extract_indexed(s, "total_pop", mappings={"year": year}).collect()
    assert [r.year for r in t] == [1960]                                 # total_mig_pop does not match
    unmatched = draws.extract_indexed(s, "fert", mappings=[("year", year.where("number < 2")), ("age", age)])
    assert [r.year for r in unmatched.collect()] == [2]                  # unmatched index kept
    with pytest.raises(ValueError):
        draws.extract_indexed(s, "fert")


def test_scenario_report_shape(spark):
    rng = np.random.default_rng(5)
    rows = []
    for run in ("included", "not included"):
        for t in range(1, 17):
            for i in range(200):
                rows.append((run, f"total_pop[{t}]", 1 + i % 4, i // 4 + 1, float(rng.lognormal(4, 1))))
    s = draws.summarise_draws(_d(spark, rows), probs=(0.05, 0.5, 0.95))
    year = spark.createDataFrame([(i, 1945 + 5 * i) for i in range(1, 17)], "number int, value int")
    rep = reports.scenario_report(s, year).collect()
    assert len(rep) == 32
    assert list(rep[0].asDict()) == ["survey", "year", "mean", "q5", "median", "q95"]
    assert [(r.survey, r.year) for r in rep] == sorted((r.survey, r.year) for r in rep)
    assert all(r.q5 <= r.median <= r.q95 for r in rep)


def test_exp_normal_totals_match_golden_row(spark):
    """With no data the 1950 cohort total is exp(Normal(4, 1)); 4,000 draws
    reproduce the published "not included" 1950 row within Monte Carlo error."""
    rng = np.random.default_rng(111)
    vals = np.exp(rng.normal(4, 1, size=4000))
    rows = [("nd", "total_pop[1]", 1 + i % 4, i // 4 + 1, float(v)) for i, v in enumerate(vals)]
    s = draws.summarise_draws(_d(spark, rows), probs=(0.05, 0.5, 0.95)).collect()[0]
    assert s.mean == pytest.approx(90.4, rel=0.1)
    assert s.q5 == pytest.approx(10.0, rel=0.15)
    assert s.q50 == pytest.approx(53.8, rel=0.1)
    assert s.q95 == pytest.approx(293.8, rel=0.15)


def test_derive_draws_sums_per_draw(spark):
    rows = [("r", f"pop_mig_true[{m},{t},{a}]", 1, 1, float(m * 100 + t * 10 + a))
            for m in (1, 2) for t in (1, 2) for a in (1, 2)]
    same = F.get(F.col("_idx"), 0) == F.get(F.col("_idx"), 1)
    out = {r.variable: r.value for r in
           draws.derive_draws(_d(spark, rows), "pop_mig_true", "pop_mig_init_total", keep=[1], where=same).collect()}
    assert out == {"pop_mig_init_total[1]": 111.0 + 112.0, "pop_mig_init_total[2]": 221.0 + 222.0}
