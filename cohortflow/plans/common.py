"""Shared building blocks of the registered queries (Spark side)."""

from __future__ import annotations

import contextlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims, rates
from ..session import balance
from ..sources import fixtures as _fx

_ACTIVE = threading.local()
# population records that are broadcast: 5,000 of some 10 KB are 50 MB
BROADCAST_POPULATIONS = 5_000


class QueryInputs:
    """Inputs shared by the steps of one registered query.

    The rate fixtures all derive from one aggregate of the fact tables and
    the survival table feeds dimensions, bin edges, grids and the model
    input. Both are materialised once per query with a reliable
    ``checkpoint()`` (into the cluster's shared ``spark.checkpoint.dir``),
    so the fact tables are scanned once however often those small tables
    are used; nothing is kept across queries.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._base = None
        self._surv = None

    @property
    def base(self) -> DataFrame:
        if self._base is None:
            from ..session import ensure_checkpoint_dir
            ensure_checkpoint_dir(self.spark)
            self._base = _fx.fixture(self.spark, self.sf_dir, "v_rate_base").checkpoint()
        return self._base

    @property
    def survival(self) -> DataFrame:
        if self._surv is None:
            self._surv = rates.survival_ratios(fixture(self.spark, self.sf_dir, "v_life"))
        return self._surv


@contextlib.contextmanager
def query_inputs(spark: SparkSession, sf_dir: str):
    prev = getattr(_ACTIVE, "inputs", None)
    _ACTIVE.inputs = QueryInputs(spark, sf_dir)
    try:
        yield _ACTIVE.inputs
    finally:
        _ACTIVE.inputs = prev


def _inputs(spark: SparkSession, sf_dir: str) -> QueryInputs | None:
    inp = getattr(_ACTIVE, "inputs", None)
    return inp if inp is not None and inp.spark is spark and inp.sf_dir == sf_dir else None


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture view; rate views come from the query's materialised aggregate."""
    inp = _inputs(spark, sf_dir)
    if inp is not None and name in _fx.RATE_VIEWS:
        return _fx.fixture(spark, sf_dir, name, base=inp.base)
    return _fx.fixture(spark, sf_dir, name)


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    inp = _inputs(spark, sf_dir)
    if inp is not None:
        return inp.survival
    return rates.survival_ratios(fixture(spark, sf_dir, "v_life"))


def fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.tidy_rates(fixture(spark, sf_dir, "v_fert_wide"), "fert",
                            period_is_range=True, scale=1000, max_year=2025, age_stops="-")


def stacked_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sheets of the wide population table, the first one winning where they overlap."""
    return rates.union_sheets([fixture(spark, sf_dir, "v_pop_wide"), fixture(spark, sf_dir, "v_pop_wide_proj")],
                              keys=["region", "period"])


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.tidy_rates(stacked_population(spark, sf_dir).drop("sheet"), "pop", max_year=2020)


def year_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.year_dim(survival(spark, sf_dir))


def age_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.age_dim(survival(spark, sf_dir))


def explode_pos(df: DataFrame, keys, array_col, pos: str, value: str) -> DataFrame:
    """posexplode that keeps computed arrays from being re-inlined.

    A plain ``posexplode`` makes the optimizer infer ``size(arr) > 0`` and
    push it below the projections, which copies the array's whole
    expression into the filter (evaluated again per row). The outer form
    infers nothing; empty or NULL arrays are dropped by a filter on the
    generated position instead.
    """
    out = df.select(*keys, F.posexplode_outer(array_col).alias(pos, value))
    return out.where(F.col(pos).isNotNull())


def posexplode_array(df: DataFrame, keys, array_col: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """Array column -> long rows (keys, 1-based pos, value) for comparison."""
    return explode_pos(df, keys, array_col, pos, value).withColumn(pos, F.col(pos) + 1)


def survey_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey counts' axes (periods, ages, their edges) from the rate tables."""
    from ..operators import survey
    return survey.axes_from_rates(survival(spark, sf_dir))


def banded_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import survey
    listed = survey.exclude_listed(fixture(spark, sf_dir, "v_band"), fixture(spark, sf_dir, "v_list"),
                                   "tribe", "tribe_name")
    return listed.where(F.col("age_member").isNotNull())


# Fixed values of the banded-survey fixture: birth places counted as native.
NATIVE_BIRTH_PLACES = ("small", "red")


# ---------------------------------------------------------------- (population, draw) rows

def _p(i) -> F.Column:
    """Raw draw value i (0-based, cyclic over the 64 embedding dims)."""
    idx = (i % 64) + 1
    return F.element_at("embedding", idx.cast("int") if isinstance(idx, F.Column) else F.lit(idx)).cast("double")


def _vec(n, offset, scale=4.0, shift=0.0):
    return F.transform(F.sequence(F.lit(1), n), lambda a: F.lit(shift) + F.lit(scale) * _p(offset + a - 1))


def _mat(rows, cols, offset, scale=4.0, shift=0.0):
    return F.transform(F.sequence(F.lit(1), rows), lambda t: F.transform(
        F.sequence(F.lit(1), cols), lambda a: F.lit(shift) + F.lit(scale) * _p(offset + (t - 1) * cols + a - 1)))


def mig_share_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin-population age shares [period][age] per region, from both
    sheets, keyed to the population's own (period, age) cells so row t and
    column a mean the same period and age as in the rate matrices."""
    from ..operators import rates as r
    pop = r.tidy_rates(stacked_population(spark, sf_dir), "pop", ids=("region", "period", "sheet"))
    shares = r.age_shares(pop).select("region", "year", "age", "pop_prop")
    cells = survival(spark, sf_dir).select("region", "year", "age").join(shares, ["region", "year", "age"], "left")
    m = dims.keyed_matrix(cells, "pop_prop", by=["region"])
    return m.select("region", F.col("matrix").alias("mig_props"))


def draw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (population, draw): model input joined to the draw's raw
    parameters (read from the embedding dims) — the projection's input."""
    from ..operators import rates as r
    surv = survival(spark, sf_dir)
    mi = dims.model_input(surv, r.align_fertility(fertility(spark, sf_dir), surv))
    prof = r.initial_age_profile(r.age_shares(population(spark, sf_dir))).select("region", "profile")
    # the per-population inputs are small (one row per population): join them
    # to each other first, then join the draws once
    pops = mi.join(prof, "region", "left").join(mig_share_matrix(spark, sf_dir), "region", "left")
    # only the narrow draws move, to spread their work over the cores; the
    # population records (a few KB each) go to them while they are few
    rows = balance(fixture(spark, sf_dir, "v_rows"), "region", "draw")
    if surv.select("region").distinct().count() <= BROADCAST_POPULATIONS:
        pops = F.broadcast(pops)
    rows = rows.join(pops, "region")
    K, T, NF = F.col("K"), F.col("Time"), F.col("n_fert_ages")
    return rows.select(
        "region", "draw", "chain", "iteration", "K", "Time", "prop_f", "n_fert_ages",
        "ages_before_fert", "ages_after_fert", "surv_mean", "fert_mean", "profile", "mig_props",
        F.abs(_p(0)).alias("sigma_surv"), F.abs(_p(1)).alias("sigma_fert"),
        (F.lit(100.0) * (F.abs(_p(2)) + F.lit(1.0))).alias("sigma_pop"),
        _mat(T, K, 3).alias("logit_surv_raw"),
        _mat(T, NF, 5).alias("log_fert_sub_raw"),
        (F.lit(4.0) * _p(7)).alias("log_pop_0_total_true_raw"),
        _vec(K, 9).alias("log_pop_0_ratios_raw"),
        F.transform(F.sequence(F.lit(1), K), lambda a: F.exp(_p(11 + a - 1))).alias("gamma_dirichlet"),
        _vec(T, 13, shift=4.0).alias("log_pop_mig_init_total"),
        _mat(T, K, 17).alias("log_pop_mig_init_ratios"),
    )


def projected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw_rows plus per-draw survival, fertility and reproduction arrays."""
    from ..operators import cohort as c
    d = draw_rows(spark, sf_dir).withColumns({
        "surv": c.survival_from_draw("surv_mean", "logit_surv_raw", "sigma_surv"),
        "fert": c.fertility_from_draw("fert_mean", "log_fert_sub_raw", "sigma_fert",
                                      "ages_before_fert", "ages_after_fert"),
    })
    return d.withColumn("reprod", c.reproduction("surv", "fert", "prop_f"))


def long3(df: DataFrame, keys, col: str, names=("t", "a"), value: str = "value") -> DataFrame:
    """[t][a] array column -> rows (keys, t, a, value), 1-based."""
    o = explode_pos(df, keys, col, "_t", "_row")
    o = explode_pos(o, [*keys, "_t"], "_row", "_a", value)
    return o.select(*keys, (F.col("_t") + 1).alias(names[0]), (F.col("_a") + 1).alias(names[1]), value)
