from pyspark.sql import functions as F

from cohortflow.operators import dims, survey


def test_band_limits_and_spread_conserve_counts(spark):
    counts = spark.createDataFrame(
        [("Below 15", 1964.0, 30), ("15-25", 1970.0, 10), ("60+", 1980.0, 4)],
        "age_member string, mig_year double, n long")
    spread = survey.spread_bands(counts, "age_member", keep=["mig_year"])
    rows = spread.collect()
    # 'Below 15' -> 0..14 (15 rows of 2.0); '15-25' -> 15..24 (end exclusive); '60+' not spread
    assert len([r for r in rows if r.mig_year == 1964.0]) == 15
    assert sorted(r.age for r in rows if r.mig_year == 1970.0) == list(range(15, 25))
    total = sum(r.n for r in rows)
    assert abs(total - 40.0) < 1e-9
    unspread = survey.unspread_bands(counts, "age_member").collect()
    assert [r.age_member for r in unspread] == ["60+"]


def test_exclude_listed_keeps_null_keys(spark):
    df = spark.createDataFrame([("X", 1), ("L1", 2), (None, 3)], "tribe string, id int")
    lst = spark.createDataFrame([("L1",)], "tribe_name string")
    out = survey.exclude_listed(df, lst, "tribe", "tribe_name").orderBy("id").collect()
    assert [r.id for r in out] == [1, 3]


def test_count_cohort_age_grid(spark):
    persons = spark.createDataFrame([
        (2, 34.0, 1967.0, 3.0, 0),    # -> (1965, 30)
        (2, 30.0, 1970.0, 2.0, 0),    # edge: lower closed -> (1970, 30)
        (2, 101.0, 2030.0, 40.0, 0),  # open top age, last year edge closed -> (2025, 45)
        (2, 20.0, 1949.0, 1.0, 0),    # before the first edge -> dropped
        (2, 8.0, None, None, 1),      # native only
        (1, 50.0, 1960.0, 5.0, 0),    # filtered by gender
    ], "basic_gender int, basic_age double, year_migration_m double, age_migration_m double, born_kenya_m int")
    rates = spark.createDataFrame([(1950 + 5 * t, 5 * a) for t in range(16) for a in range(10)], "year int, age int")
    axes = survey.axes_from_rates(rates)
    grid = survey.count_cohort_age(persons, axes)
    rows = {(r.mig_year, r.age): r.n for r in grid.collect()}
    assert len(rows) == 16 * 10
    assert rows[(1965, 30)] == 1 and rows[(1970, 30)] == 1 and rows[(2025, 45)] == 1
    assert sum(rows.values()) == 3
    nat = {r.age: r.n for r in survey.count_native_age(persons, axes).collect()}
    assert nat[5] == 1 and sum(nat.values()) == 1


def test_complete_grid_has_no_cross_join(spark):
    counts = spark.createDataFrame([(1950, 0, 2.0)], "mig_year int, age int, n double")
    years = spark.createDataFrame([(1950,), (1955,)], "value int")
    ages = spark.createDataFrame([(0,), (5,), (10,)], "age int")
    g = dims.complete_grid(counts, {"mig_year": years, "age": ages})
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert g.count() == 6 and g.agg(F.sum("n")).collect()[0][0] == 2.0
