"""Array operators against dense NumPy Leslie matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortflow.functions.scalar import once
from cohortflow.operators import cohort
from tests.dense import project_block


def _leslie(s, r):
    K = len(r)
    L = np.zeros((K, K))
    L[0, :] = r
    for a in range(1, K):
        L[a, a - 1] = s[a]
    L[K - 1, K - 1] += s[K]
    return L


def _frame(spark, T=6, K=5, seed=0):
    rng = np.random.default_rng(seed)
    surv = [rng.uniform(0.5, 0.99, K).tolist() + [0.0] for _ in range(T)]
    fert = [[0.0] + rng.uniform(0.0, 0.4, K - 2).tolist() + [0.0, 0.0] for _ in range(T)]
    pop0 = rng.uniform(10, 100, K).tolist()
    df = spark.createDataFrame([(surv, fert, pop0, 0.5)],
                               "surv array<array<double>>, fert array<array<double>>, pop0 array<double>, prop_f double")
    return df.withColumn("reprod", cohort.reproduction("surv", "fert", "prop_f")), surv, fert, pop0


@pytest.mark.parametrize("offset", [0, 1])
def test_project_closed_matches_numpy(spark, offset):
    df, surv, fert, pop0 = _frame(spark)
    r = df.select("reprod", cohort.project_closed("pop0", "surv", "reprod", offset).alias("p")).collect()[0]
    T, K = len(surv), len(pop0)
    reprod = np.array(r.reprod)
    for t in range(T):
        s, f = np.array(surv[t]), np.array(fert[t])
        expect = 2.5 * s[0] * 0.5 * (f[:K] + f[1:K + 1] * s[1:K + 1])
        assert np.allclose(reprod[t], expect, rtol=1e-13)
    pop = np.array(pop0)
    got = np.array(r.p)
    assert np.allclose(got[0], pop)
    for t in range(1, T):
        L = _leslie(np.array(surv[t - offset]), reprod[t - offset])
        pop = L @ pop
        assert np.allclose(got[t], pop, rtol=1e-12)


def _migrants(df, t_obs):
    df = df.withColumn("tot", cohort.zero_after("tot", F.lit(t_obs)))
    df = once(df, start=cohort.migrant_starts("tot", "sh"))
    df = once(df, grid=cohort.survivorship("surv"), pooled=cohort.pooled_migrants("start", "surv"))
    df = once(df, b=cohort.migrant_births("pooled", "reprod"))
    return once(df, nat=cohort.project_native("b", "surv", "reprod", F.lit(5)))


def test_disaggregated_equals_dense(spark):
    T, K = 6, 5
    df, surv, fert, pop0 = _frame(spark, T=T, K=K, seed=2)
    surv[2][1] = surv[3][3] = 0.0  # nobody survives: the diagonals begin anew
    df = spark.createDataFrame([(surv, fert, pop0, 0.5)], df.select("surv", "fert", "pop0", "prop_f").schema)
    df = df.withColumn("reprod", cohort.reproduction("surv", "fert", "prop_f"))
    df = df.withColumn("tot", F.array(*[F.lit(float(10 * (m + 1))) for m in range(T)]))
    df = df.withColumn("sh", F.array(*[F.array(*[F.lit(0.1 * (a + 1)) for a in range(K)]) for _ in range(T)]))
    d = _migrants(df, 4)
    seen = [cohort.cohorts_at("start", "grid", t).alias(f"seen{t}") for t in range(1, T + 1)]
    r = d.select("tot", "pooled", "b", "nat", "reprod", "start", cohort.cohort_sizes("start", "grid").alias("sizes"),
                 cohort.totals("nat", "pooled"), *seen).collect()[0]
    assert r.tot[4:] == [0.0, 0.0]              # no arrivals after t_obs
    coh, births, native = project_block(*[np.array([x]) for x in (surv, r.reprod, r.start)])
    coh = coh[0]                                # [m][t][a]
    assert np.allclose(r.sizes, coh.sum(axis=2)) and np.allclose(r.pooled, coh.sum(axis=0))
    assert np.allclose(r.b, births[0]) and np.allclose(r.nat, native[0])
    for t in range(T):
        assert np.allclose(r[f"seen{t + 1}"], coh[:, t])
        assert r.totals[t].native == pytest.approx(native[0, t].sum())
        assert r.totals[t].migrant == pytest.approx(coh[:, t].sum())
    for m in range(T):
        assert np.all(coh[m, :m] == 0) and np.all(np.diff(coh[m].sum(axis=1)[m:]) <= 1e-12)


def test_null_matrices_give_null(spark):
    df, surv, fert, pop0 = _frame(spark, T=6, K=5)
    schema = "surv array<array<double>>, fert array<array<double>>, prop_f double, tot array<double>, sh array<array<double>>"
    sh, hole = [[0.2] * 5 for _ in range(6)], [[0.2] * 5 for _ in range(6)]
    hole[1] = [0.2, None, 0.2, 0.2, 0.2]
    rows = [(surv, fert, 0.5, [1.0] * 6, None), (None, None, 0.5, [1.0] * 6, sh), (surv, fert, 0.5, None, sh),
            (surv, fert, 0.5, [1.0] * 6, hole)]
    d = spark.createDataFrame(rows, schema).withColumn("reprod", cohort.reproduction("surv", "fert", "prop_f"))
    out = _migrants(d, 0).select("pooled", "b", "nat", cohort.cohort_sizes("start", "grid").alias("s"),
                                 cohort.cohorts_at("start", "grid", 3).alias("c")).collect()
    for r in out[:3]:
        assert r.s is None or r.s[0][0] is None
    holed = out[3]
    assert holed.s[1][1] is None and holed.s[0][5] is not None and holed.c[1][2] is None
    assert holed.pooled[0][0] is not None and holed.pooled[1][1] is None


def test_fold_keeps_nulls(spark):
    df = spark.createDataFrame([([0.0, 5.0, None, 7.0], [[0.5, 0.5, 0.5]] * 4, [[1.0, 1.0]] * 4)],
                               "births array<double>, surv array<array<double>>, reprod array<array<double>>")
    out = df.select(cohort.project_native("births", "surv", "reprod", F.lit(2))).collect()[0][0]
    assert out[2][0] is None                    # a NULL birth count must not become 0


def test_shares(spark):
    df = spark.createDataFrame([([0.1] * 12, [0.05 + 0.01 * i for i in range(12)], [1.0, 2.0, 3.0])],
                               "raw array<double>, p array<double>, g array<double>")
    r = df.select(cohort.shares_softmax("raw", "p").alias("s"), cohort.shares_gamma("g").alias("d")).collect()[0]
    assert sum(r.s) == pytest.approx(1.0) and sum(r.d) == pytest.approx(1.0)
    # a common shift of the raw values cancels inside softmax
    p = np.array([0.05 + 0.01 * i for i in range(12)])
    assert np.allclose(r.s, p / p.sum())


def test_gaps_zero_rates_and_certain_survival(spark):
    """A missing middle age, a zero fertility and a survival of 1 against NumPy."""
    from cohortflow.operators import dims
    ages, years = [0, 5, 10, 15], [1950, 1955, 1960]
    surv = {(y, a): 0.9 - 0.1 * i + 0.01 * j for i, a in enumerate(ages) for j, y in enumerate(years)}
    surv[1955, 10] = 1.0
    fert = {(y, a): 0.3 if a == 10 else 0.0 for y in years for a in ages} | {(1950, 5): 0.2}
    rows = [("A", y, a, v) for (y, a), v in surv.items() if (y, a) != (1955, 5)]
    s = spark.createDataFrame(rows, "region string, year int, age int, surv double")
    f = spark.createDataFrame([("A", y, a, v) for (y, a), v in fert.items()],
                              "region string, year int, age int, fert double")
    mi = dims.model_input(s, f).collect()[0]
    want = dict(surv) | {(1955, 5): surv[1950, 5]}  # carried forward
    assert np.allclose(mi.surv_mean, [[want[y, a] for a in ages] for y in years])
    assert mi.fertile_ages == [5, 10] and mi.fert_mean == [[0.2, 0.3], [0.0, 0.3], [0.0, 0.3]]
    assert [(r.year, r.age) for r in dims.missing_cells(s, "surv").collect()] == [(1955, 5)]
    raw = [[0.1] * 4] * 3, [[0.2] * 2] * 3
    df = spark.createDataFrame([(mi.surv_mean, mi.fert_mean, *raw, 0.5)],
                               "sm array<array<double>>, fm array<array<double>>, sr array<array<double>>, "
                               "fr array<array<double>>, sigma double")
    r = df.select(cohort.survival_from_draw("sm", "sr", "sigma").alias("s"),
                  cohort.fertility_from_draw("fm", "fr", "sigma", F.lit(1), F.lit(1)).alias("f")).collect()[0]
    with np.errstate(divide="ignore"):
        m = np.array(mi.surv_mean)
        expect = 1 / (1 + np.exp(-(np.log(m / (1 - m)) + 0.05)))
        assert np.allclose(np.array(r.s)[:, :4], expect) and r.s[1][2] == 1.0
        assert np.allclose(np.array(r.f)[:, 1:3], np.exp(np.log(np.array(mi.fert_mean)) + 0.1))
    df0 = spark.createDataFrame([([[0.0, 1.0]],)], "sm array<array<double>>")
    assert df0.select(cohort.survival_from_draw("sm", F.array(F.array(F.lit(1.0), F.lit(1.0))), F.lit(1.0))
                      ).collect()[0][0] == [[0.0, 1.0, 0.0]]
