from cohortflow.operators import rates


def test_survival_ratios_fixture(spark):
    life = spark.createDataFrame([
        ("A", "1950-1955", 0, "90000"),
        ("A", "1950-1955", 1, "340000"),
        ("A", "1950-1955", 5, "410000"),
        ("A", "1950-1955", 10, "0"),
        ("A", "1950-1955", 15, "390000"),
    ], "region string, period string, age int, Lx string")
    out = {r.age: r.surv for r in rates.survival_ratios(life, keep_last=True).collect()}
    assert out[0] == 410000 / 430000       # ages 0 and 1 merged
    assert out[5] == 0.0
    assert out[10] is None                  # division by zero -> NULL
    assert out[15] is None                  # open top age has no next age
    kept = {r.age for r in rates.survival_ratios(life).collect()}
    assert kept == {0, 5}


def test_tidy_rates_and_shares(spark):
    wide = spark.createDataFrame([("A", "1950", "10", "30", "…", "x")],
                                 "region string, period string, `0-4` string, `5-9` string, `100+` string, Notes string")
    long = rates.tidy_rates(wide, "pop").collect()
    assert {(r.age, r.pop) for r in long} == {(0, 10.0), (5, 30.0), (100, None)}
    shares = rates.age_shares(rates.tidy_rates(wide, "pop")).collect()
    assert all(r.pop_prop is None for r in shares)   # a NULL makes the total NULL
    shares_rm = rates.age_shares(rates.tidy_rates(wide, "pop"), na_rm=True).collect()
    assert {r.age: r.pop_prop for r in shares_rm}[5] == 0.75


def test_union_sheets_prefers_first(spark):
    a = spark.createDataFrame([("A", "2020", "1")], "region string, period string, v string")
    b = spark.createDataFrame([("A", "2020", "2"), ("A", "2025", "3")], "region string, period string, v string")
    out = {r.period: (r.v, r.sheet) for r in rates.union_sheets([a, b], ["region", "period"]).collect()}
    assert out == {"2020": ("1", 1), "2025": ("3", 2)}
