"""Registered queries: one per operator family, each (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through the fixture views and runs
over the whole tables. Doubles are rounded at the end so results can be
compared by hash with the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims, draws, rates, reports
from ..session import round_doubles, settle
from . import common
from .common import fixture

Q = {}


def register(fn):
    """Register a query; its steps share one materialised set of inputs."""
    import functools

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with common.query_inputs(spark, sf_dir):
            return fn(spark, sf_dir)

    Q[fn.__name__.removeprefix("q_")] = run
    return run


# ------------------------------------------------------------ slice 1: report

@register
def q_scenario_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = draws.summarise_draws(fixture(spark, sf_dir, "v_draws1"), probs=(0.05, 0.5, 0.95))
    rep = reports.scenario_report(summary, common.year_dim(spark, sf_dir))
    return round_doubles(rep)


@register
def q_summarise_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(draws.summarise_draws(fixture(spark, sf_dir, "v_draws2")))


@register
def q_summarise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a few event types own the whole table: groups of any size
    return round_doubles(draws.summarise_draws(fixture(spark, sf_dir, "v_events"), unbounded=True))


# ------------------------------------------------------------ slice 2: index parsing

def _summary(spark, sf_dir, view, probs=(0.05, 0.5, 0.95)):
    return draws.summarise_draws(fixture(spark, sf_dir, view), probs=probs)


@register
def q_extract_indexed_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(spark, sf_dir, "v_draws1")
    out = draws.extract_indexed(s, "total_pop", mappings={"year": common.year_dim(spark, sf_dir)},
                                keep_variable=True)
    return round_doubles(out)


@register
def q_extract_indexed_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(spark, sf_dir, "v_draws2")
    out = draws.extract_indexed(s, "fert", mappings=[("year", common.year_dim(spark, sf_dir)),
                                                     ("age", common.age_dim(spark, sf_dir))])
    return round_doubles(out)


@register
def q_extract_indexed_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(spark, sf_dir, "v_draws3")
    ydim = common.year_dim(spark, sf_dir)
    out = draws.extract_indexed(s, "pop_mig_true", mappings=[("mig_year", ydim), ("year", ydim),
                                                             ("age", common.age_dim(spark, sf_dir))])
    return round_doubles(out)


@register
def q_extract_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(spark, sf_dir, "v_draws2")
    return round_doubles(draws.extract_indexed(s, "fert_sub", indices=["t", "a"], keep_variable=True))


@register
def q_population_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(spark, sf_dir, "v_draws1")
    out = reports.population_parts(s, common.year_dim(spark, sf_dir))
    return round_doubles(out.select("run_id", "population", "year", "mean", "q5", "q50", "q95"))


@register
def q_migration_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(spark, sf_dir, "v_draws3")
    out = reports.migration_detail(s, common.year_dim(spark, sf_dir), common.age_dim(spark, sf_dir))
    return round_doubles(out.select("run_id", "mig_year", "year", "age", "q5", "q50", "q95",
                                    "mig_label", "year_label"))


def cohort_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort draws plus per-draw derived arrival totals and their logs."""
    d3 = fixture(spark, sf_dir, "v_draws3")
    same = F.get(F.col("_idx"), 0) == F.get(F.col("_idx"), 1)
    total = draws.derive_draws(d3, "pop_mig_true", "pop_mig_init_total", keep=[1], where=same)
    logs = total.select("run_id", F.concat(F.lit("log_"), "variable").alias("variable"),
                        "chain", "iteration", F.ln("value").alias("value"))
    return d3.unionByName(total).unionByName(logs)


@register
def q_migration_inflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = draws.summarise_draws(cohort_draws(spark, sf_dir), probs=(0.05, 0.5, 0.95))
    out = reports.migration_inflow(s, common.year_dim(spark, sf_dir))
    return round_doubles(out.select("run_id", "year", "mean", "sd", "q5", "q50", "q95"))


# ------------------------------------------------------------ slice 3: rate tidying

@register
def q_tidy_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(common.fertility(spark, sf_dir))


@register
def q_tidy_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(common.population(spark, sf_dir))


@register
def q_union_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(rates.tidy_rates(common.stacked_population(spark, sf_dir), "pop",
                                          ids=("region", "period", "sheet")))


@register
def q_survival_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(common.survival(spark, sf_dir))


def shares_in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    surv = common.survival(spark, sf_dir)
    shares = rates.age_shares(common.population(spark, sf_dir))
    return rates.restrict_to_domain(shares, year=dims.year_dim(surv).select("value"),
                                    age=surv.select("age"))


@register
def q_age_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shares_in_domain(spark, sf_dir)
    return round_doubles(out.select("region", "year", "age", "pop", "pop_prop"))


@register
def q_initial_age_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = rates.initial_age_profile(rates.age_shares(common.population(spark, sf_dir)))
    out = common.explode_pos(prof, ["region"], F.arrays_zip("ages", "profile"), "pos", "z")
    return round_doubles(out.select("region", (F.col("pos") + 1).alias("pos"),
                                    F.col("z.ages").alias("age"), F.col("z.profile").alias("share")))


@register
def q_align_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rates.align_fertility(common.fertility(spark, sf_dir), common.survival(spark, sf_dir))
    return round_doubles(out)


# ------------------------------------------------------------ slice 4: dims

@register
def q_age_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.age_dim(spark, sf_dir)


@register
def q_year_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.year_dim(spark, sf_dir)


@register
def q_period_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = dims.period_edges(common.year_dim(spark, sf_dir))
    return common.posexplode_array(edges, [], "edges", "pos", "edge")


# ------------------------------------------------------------ slice 4: survey counts

from ..operators import intervals, survey  # noqa: E402


@register
def q_count_cohort_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survey.count_cohort_age(fixture(spark, sf_dir, "v_person"), common.survey_axes(spark, sf_dir))
    return out.withColumn("n", F.col("n").cast("bigint"))


@register
def q_count_native_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survey.count_native_age(fixture(spark, sf_dir, "v_person"), common.survey_axes(spark, sf_dir))
    return out.withColumn("n", F.col("n").cast("bigint"))


@register
def q_dropped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that the count grids leave out, by reason."""
    return survey.dropped_counts(fixture(spark, sf_dir, "v_person"), common.survey_axes(spark, sf_dir))


@register
def q_unspread_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of open bands, which cannot be spread over single years."""
    counts = survey.count_by(common.banded_survey(spark, sf_dir), ["age_member"])
    return survey.unspread_bands(counts, "age_member")


@register
def q_count_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    surv = common.survival(spark, sf_dir)
    edges = survey.stepped_edges(surv)
    domain = edges.select(F.explode("edges").alias("age")).where(F.col("age") < float("inf"))
    return survey.count_full_outer(fixture(spark, sf_dir, "v_household"), edges, domain)


@register
def q_exclude_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.exclude_listed(fixture(spark, sf_dir, "v_band"), fixture(spark, sf_dir, "v_list"),
                                 "tribe", "tribe_name")


@register
def q_restrict_to_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    surv = common.survival(spark, sf_dir)
    out = rates.restrict_to_domain(common.fertility(spark, sf_dir),
                                   year=dims.year_dim(surv).select("value"), age=surv.select("age"))
    return round_doubles(out)


@register
def q_banded_migrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(survey.banded_migrants(common.banded_survey(spark, sf_dir),
                                                common.survey_axes(spark, sf_dir)))


@register
def q_banded_natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survey.banded_natives(common.banded_survey(spark, sf_dir), common.survey_axes(spark, sf_dir),
                                common.NATIVE_BIRTH_PLACES)
    return round_doubles(out)


@register
def q_banded_natives_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native-born who never moved, bands spread to their last year inclusive."""
    out = survey.banded_natives(common.banded_survey(spark, sf_dir), common.survey_axes(spark, sf_dir),
                                common.NATIVE_BIRTH_PLACES, native_only_non_applicable=True, inclusive_end=True)
    return round_doubles(out)


@register
def q_survival_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival at the age it leads to, 1 at birth."""
    return round_doubles(rates.shift_survival(common.survival(spark, sf_dir)).select("region", "year", "age", "surv"))


@register
def q_count_region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons per age group, every region with edges of its own; a NULL group holds those outside."""
    raw = survey.count_by(fixture(spark, sf_dir, "v_region_person"), ["region", "age"])
    binned = intervals.bin_by_table(raw, fixture(spark, sf_dir, "v_region_edges"), ["region"], "age")
    return binned.groupBy("region", "bin").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------ slice 5: arrays and model input

@register
def q_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = survey.count_cohort_age(fixture(spark, sf_dir, "v_person"), common.survey_axes(spark, sf_dir))
    mat = dims.to_matrix(grid, "mig_year", "age", "n")
    rows = common.explode_pos(mat, [], F.arrays_zip("mig_years", "matrix"), "r", "z")
    rows = rows.select((F.col("r") + 1).alias("row_pos"), F.col("z.mig_years").alias("mig_year"),
                       F.col("z.matrix").alias("cells"))
    cells = common.explode_pos(rows, ["row_pos", "mig_year"], "cells", "c", "value")
    return round_doubles(cells.select("row_pos", (F.col("c") + 1).alias("col_pos"), "mig_year", "value"))


@register
def q_fertile_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    af = rates.align_fertility(common.fertility(spark, sf_dir), common.survival(spark, sf_dir))
    out = dims.fertile_window(af, by=["region"])
    return out.select("region", *[F.col(c).cast("bigint").alias(c) for c in out.columns if c != "region"])


@register
def q_model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    surv = common.survival(spark, sf_dir)
    af = rates.align_fertility(common.fertility(spark, sf_dir), surv)
    mi = dims.model_input(surv, af)
    flat_s = F.flatten("surv_mean")
    flat_f = F.flatten("fert_mean")
    from ..functions.scalar import arr_sum
    out = mi.select(
        "region", *[F.col(c).cast("bigint").alias(c) for c in
                    ("K", "Time", "n_fert_ages", "ages_before_fert", "ages_after_fert")],
        "prop_f",
        F.size(flat_s).cast("bigint").alias("surv_cells"), arr_sum(flat_s).alias("surv_total"),
        F.size(flat_f).cast("bigint").alias("fert_cells"), arr_sum(flat_f).alias("fert_total"))
    return round_doubles(out)


@register
def q_model_input_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the rate matrices at its place (t, a), with the period and age it stands for."""
    surv = common.survival(spark, sf_dir)
    af = rates.align_fertility(common.fertility(spark, sf_dir), surv)
    mi = dims.model_input(surv, af)
    parts = [("surv", "surv_mean", "ages"), ("fert", "fert_mean", "fertile_ages")]
    out = None
    for name, matrix, ages in parts:
        rows = common.explode_pos(mi, ["region", F.col(ages).alias("_ages")], F.arrays_zip("years", matrix), "_t", "_z")
        rows = rows.select("region", (F.col("_t") + 1).alias("t"), F.col("_z.years").alias("year"),
                           F.arrays_zip(F.col("_ages").alias("age"), F.col(f"_z.{matrix}").alias("value")).alias("_r"))
        rows = common.explode_pos(rows, ["region", "t", "year"], "_r", "_a", "c")
        rows = rows.select("region", F.lit(name).alias("field"), "t", (F.col("_a") + 1).alias("a"), "year",
                           F.col("c.age").alias("age"), F.col("c.value").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return round_doubles(out)


@register
def q_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the population's (period, age) grid without an input rate, which are carried forward."""
    return dims.missing_cells(common.survival(spark, sf_dir), "surv")


# ------------------------------------------------------------ slice 6: diagnostics

from ..operators import diagnostics  # noqa: E402


@register
def q_rhat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(diagnostics.rhat(fixture(spark, sf_dir, "v_draws1")))


@register
def q_unequal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables without R-hat and ESS because their chains differ in length (events: ragged chains)."""
    d = fixture(spark, sf_dir, "v_draws1").unionByName(fixture(spark, sf_dir, "v_events").withColumn(
        "iteration", F.lit(0)))
    return diagnostics.unequal_chains(d)


def _ess(spark, sf_dir):
    return diagnostics.ess(fixture(spark, sf_dir, "v_draws1"))


@register
def q_ess_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_ess(spark, sf_dir).select("run_id", "variable", "ess_bulk"))


@register
def q_ess_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_ess(spark, sf_dir).select("run_id", "variable", "ess_tail"))


from ..operators import long_chains  # noqa: E402


@register
def q_convergence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-hat and ESS of a few variables that own the whole table, one long chain each."""
    return round_doubles(long_chains.convergence(fixture(spark, sf_dir, "v_event_chain")))


# ------------------------------------------------------------ slice 7: cohort operators

from ..functions.scalar import once  # noqa: E402
from ..operators import cohort, leslie  # noqa: E402

_DRAW = ["region", "draw"]


@register
def q_survival_from_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(common.long3(common.projected_rows(spark, sf_dir), _DRAW, "surv"))


@register
def q_fertility_from_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(common.long3(common.projected_rows(spark, sf_dir), _DRAW, "fert"))


@register
def q_reproduction_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(common.long3(common.projected_rows(spark, sf_dir), _DRAW, "reprod"))


@register
def q_leslie_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = common.projected_rows(spark, sf_dir)
    ent = common.explode_pos(d, _DRAW, F.arrays_zip("surv", "reprod"), "_t", "_z")
    ent = common.explode_pos(ent.select(*_DRAW, (F.col("_t") + 1).alias("t"),
                                        cohort.leslie_entries(F.col("_z.surv"), F.col("_z.reprod")).alias("_e")),
                             [*_DRAW, "t"], "_e", "_i", "e")
    return round_doubles(ent.select(*_DRAW, "t", "e.row", "e.col", "e.value"))


@register
def q_leslie_no_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The migrant cohorts' matrices: no first row."""
    return round_doubles(leslie.triplets(common.projected_rows(spark, sf_dir), _DRAW, births=False))


@register
def q_leslie_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-year matrices: products of four consecutive periods, from sparse products."""
    m = leslie.triplets(common.projected_rows(spark, sf_dir), _DRAW)
    return round_doubles(leslie.product(m, _DRAW, 4))


@register
def q_project_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed projection by keyed joins of triplets (the same rows as project_closed)."""
    d = settle(common.projected_rows(spark, sf_dir).select(*_DRAW, "Time", "surv", "reprod", lognormal_pop0().alias("pop0")))
    start = common.explode_pos(d, _DRAW, "pop0", "a", "value").withColumn("a", F.col("a") + 1)
    periods = d.agg(F.max("Time")).first()[0] or 1
    out = leslie.project(leslie.triplets(d, _DRAW), start, _DRAW, periods)
    return round_doubles(out.select(*_DRAW, "t", "a", F.col("value").alias("pop")))


def lognormal_pop0() -> F.Column:
    shares = cohort.shares_softmax("log_pop_0_ratios_raw", "profile")
    return cohort.scale_vector(shares, cohort.initial_total("log_pop_0_total_true_raw"))


def dirichlet_pop0() -> F.Column:
    shares = cohort.shares_gamma("gamma_dirichlet")
    return cohort.scale_vector(shares, cohort.initial_total("log_pop_0_total_true_raw"))


@register
def q_project_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = common.projected_rows(spark, sf_dir)
    d = d.withColumn("pop", cohort.project_closed(lognormal_pop0(), "surv", "reprod", rate_offset=1))
    return round_doubles(common.long3(d, _DRAW, "pop", value="pop"))


@register
def q_project_closed_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = common.projected_rows(spark, sf_dir)
    d = d.withColumn("pop", cohort.project_closed(dirichlet_pop0(), "surv", "reprod", rate_offset=0))
    return round_doubles(common.long3(d, _DRAW, "pop", value="pop"))


# Fixed values of the disaggregated fixture: last observed period, ratio scale.
T_OBS = 15
SD_INIT_RATIOS = 5.0


def disaggregated(spark: SparkSession, sf_dir: str, t_obs: F.Column | None = None) -> DataFrame:
    """Draws with arrivals, diagonal survival, all migrants together, births and native-born.

    ``t_obs`` is the array of a population's observed periods; nobody arrives
    after the last one.
    """
    t_obs = F.array(F.lit(T_OBS)) if t_obs is None else t_obs
    d = common.projected_rows(spark, sf_dir).withColumn("t_obs", t_obs)
    arrivals = cohort.zero_after(F.transform("log_pop_mig_init_total", lambda v: F.exp(v)), F.element_at("t_obs", -1))
    shares = F.zip_with("log_pop_mig_init_ratios", "mig_props",
                        lambda raw, p: cohort.shares_softmax(raw, p, sd=SD_INIT_RATIOS))
    d = d.select(*_DRAW, "K", "t_obs", "surv", "reprod", cohort.migrant_starts(arrivals, shares).alias("mig_start"))
    d = once(d, surv_=F.col("surv"), reprod_=F.col("reprod"), start_=F.col("mig_start")).select(
        *_DRAW, "K", "t_obs", F.col("surv_").alias("surv"), F.col("reprod_").alias("reprod"), F.col("start_").alias("mig_start"))
    d = once(d, grid=cohort.survivorship("surv"), pooled=cohort.pooled_migrants("mig_start", "surv"))
    d = once(d, births=cohort.migrant_births("pooled", "reprod"))
    return once(d, native=cohort.project_native("births", "surv", "reprod", "K"))


@register
def q_project_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform-initial model: counts per age drawn as LogNormal(log 100, 0.3)."""
    d = common.projected_rows(spark, sf_dir)
    d = d.withColumn("pop", cohort.project_closed(uniform_pop0(), "surv", "reprod", rate_offset=0))
    return round_doubles(common.long3(d, _DRAW, "pop", value="pop"))


def arrivals_observed() -> F.Column:
    """Fixed values of the survey fixture: the observed periods of a population's migrants.

    Most populations are observed once, in period 15 as in the runs; some
    twice; some never (0).
    """
    n = F.regexp_extract("region", "([0-9]+)$", 1).cast("int")
    return F.when(n % 10 == 0, F.array(F.lit(0))).when(n % 10 == 5, F.array(F.lit(12), F.lit(T_OBS))).otherwise(
        F.array(F.lit(T_OBS)))


@register
def q_score_disaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey scored against migrants and native-born in every observed period of a population."""
    grid = survey.count_cohort_age(fixture(spark, sf_dir, "v_person"), common.survey_axes(spark, sf_dir))
    mig_obs = dims.to_matrix(grid, "mig_year", "age", "n").select("matrix").scalar()
    d = disaggregated(spark, sf_dir, arrivals_observed()).withColumns({
        "mig_obs": mig_obs, "nat_obs": _vector(native_grid(spark, sf_dir))})
    score = lambda t: scoring.score_cohorts("mig_obs", cohort.cohorts_at("mig_start", "grid", t), "nat_obs",
                                            F.try_element_at("native", t))
    # log-likelihoods of order 1e6 (unit observation sd): compared at 0.01
    return round_doubles(d.select(*_DRAW, F.size("t_obs").alias("n_obs"),
                                  scoring.over_observations("t_obs", score).alias("obs_ll")), 2)


@register
def q_project_migrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = once(disaggregated(spark, sf_dir), sizes=cohort.cohort_sizes("mig_start", "grid"))
    return round_doubles(common.long3(d, _DRAW, "sizes", ("mig_year", "t"), "pop"))


@register
def q_migrant_births(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = disaggregated(spark, sf_dir)
    out = common.explode_pos(d, _DRAW, "births", "t", "births")
    return round_doubles(out.withColumn("t", F.col("t") + 1))


@register
def q_project_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(common.long3(disaggregated(spark, sf_dir), _DRAW, "native", value="pop"))


@register
def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = disaggregated(spark, sf_dir)
    out = common.explode_pos(d, _DRAW, cohort.totals("native", "pooled"), "t", "v")
    return round_doubles(out.select(*_DRAW, (F.col("t") + 1).alias("t"), F.col("v.native").alias("native"),
                                    F.col("v.migrant").alias("migrant"),
                                    (F.col("v.native") + F.col("v.migrant")).alias("total")))


# ------------------------------------------------------------ slice 8: scoring and overlay

from ..operators import scoring  # noqa: E402


def native_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.count_native_age(fixture(spark, sf_dir, "v_person"), common.survey_axes(spark, sf_dir))


@register
def q_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = survey.count_cohort_age(fixture(spark, sf_dir, "v_person"), common.survey_axes(spark, sf_dir))
    return round_doubles(scoring.composition(grid, ["mig_year"]))


def household_grid(spark: SparkSession, sf_dir: str, top_offset: int = 0) -> DataFrame:
    """Household counts by age group; ``top_offset`` 5 opens the top bin one
    group early (the last age group then has no members), as the runs with
    Dirichlet and uniform initial populations do."""
    surv = common.survival(spark, sf_dir)
    edges = survey.stepped_edges(surv, top_offset=top_offset)
    domain = survey.stepped_edges(surv).select(F.explode("edges").alias("age")).where(F.col("age") < float("inf"))
    return survey.count_full_outer(fixture(spark, sf_dir, "v_household"), edges, domain)


def _vector(df: DataFrame, value: str = "n") -> F.Column:
    """Scalar subquery: the grid's values ordered by age (a K-vector)."""
    return df.agg(F.array_sort(F.collect_list(F.struct("age", F.col(value).cast("double").alias("v"))))
                  .alias("o")).select("o.v").scalar()


def uniform_pop0() -> F.Column:
    """Counts per age drawn as LogNormal(log 100, 0.3)."""
    return F.transform("log_pop_0_ratios_raw", lambda r: F.exp(F.lit(4.605170185988092) + F.lit(0.3) * r))


def observed_periods() -> F.Column:
    """Fixed values of the household fixture: the observed periods of a population.

    Most populations are observed once, in period 14 as in the runs; some
    twice; some never (0).
    """
    n = F.regexp_extract("region", "([0-9]+)$", 1).cast("int")
    return F.when(n % 10 == 0, F.array(F.lit(0))).when(n % 10 == 5, F.array(F.lit(12), F.lit(14))).otherwise(
        F.array(F.lit(14)))


def observed_rows(spark: SparkSession, sf_dir: str, top_offset: int) -> DataFrame:
    return common.projected_rows(spark, sf_dir).withColumns({
        "t_obs": observed_periods(), "obs": _vector(household_grid(spark, sf_dir, top_offset))})


def counts_score(pop: str) -> F.Column:
    return scoring.over_observations("t_obs", lambda t: scoring.score_normal("obs", F.try_element_at(pop, t), "sigma_pop"))


def composition_score(pop: str) -> F.Column:
    from ..functions.scalar import floor_at
    return scoring.over_observations("t_obs", lambda t: scoring.score_lognormal_composition(
        floor_at("obs", 0.001), F.try_element_at(pop, t), "sigma_pop"))


def scored(spark: SparkSession, sf_dir: str, pop0: F.Column, rate_offset: int, top_offset: int,
           composition: bool = False) -> DataFrame:
    """Household observations scored against a closed projection, at each population's observed periods."""
    d = observed_rows(spark, sf_dir, top_offset).withColumn("pop", cohort.project_closed(pop0, "surv", "reprod", rate_offset))
    score = composition_score("pop") if composition else counts_score("pop")
    return d.select(*_DRAW, F.size("t_obs").alias("n_obs"), score.alias("obs_ll"))


@register
def q_score_lognormal_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-normal initial population: Normal counts, previous period's rates."""
    return round_doubles(scored(spark, sf_dir, lognormal_pop0(), 1, 0))


@register
def q_score_lognormal_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-normal observations: total and log-ratios, the period's own rates."""
    return round_doubles(scored(spark, sf_dir, lognormal_pop0(), 0, 0, composition=True))


@register
def q_score_uniform_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform initial population: Normal counts, the period's own rates, early open bin."""
    return round_doubles(scored(spark, sf_dir, uniform_pop0(), 0, 5))


@register
def q_score_dirichlet_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirichlet initial population: Normal counts, the period's own rates, early open bin."""
    return round_doubles(scored(spark, sf_dir, dirichlet_pop0(), 0, 5))


@register
def q_score_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two models with a log-normal initial population side by side, from one row."""
    d = observed_rows(spark, sf_dir, 0).withColumn("pop0", lognormal_pop0())
    d = d.withColumns({"pop": cohort.project_closed("pop0", "surv", "reprod", 1),
                       "pop_t": cohort.project_closed("pop0", "surv", "reprod", 0)})
    return round_doubles(d.select(*_DRAW, F.size("t_obs").alias("n_obs"), counts_score("pop").alias("normal_ll"),
                                  composition_score("pop_t").alias("lognormal_ll")))


# Prior families of the totals and rates fixtures.
PRIORS = [
    ("fert", "normal", 0.0, 1.0),
    ("fert_sub", "half_normal", 0.0, 0.05),
    ("pop_mig_true", "lognormal", 4.605170185988092, 0.3),
    ("total_pop", "gamma", 2.0, 0.002),
]
# The models' priors. Raw rates are standard normal in every
# model; the scales are half-normal with each model's own hyper-scale.
DIRICHLET_FACTOR = 500
FERT_HYPER, SURV_HYPER = 0.05, 0.07
RAW_RATES = [("logit_surv_raw", "normal", 0.0, 1.0), ("log_fert_sub_raw", "normal", 0.0, 1.0)]


def _scales(pop: float | None, fert: float, surv: float) -> list[tuple]:
    out = [("sigma_fert", "half_normal", 0.0, fert), ("sigma_surv", "half_normal", 0.0, surv)]
    return out if pop is None else [("sigma_pop", "half_normal", 0.0, pop), *out]


RAW_TOTAL = ("log_pop_0_total_true_raw", "normal", 0.0, 1.0)
RAW_RATIOS = ("log_pop_0_ratios_raw", "normal", 0.0, 1.0)
MODEL_PRIORS = {
    "disaggregated": [*RAW_RATES, *_scales(None, FERT_HYPER, SURV_HYPER), ("log_pop_mig_init_total", "normal", 4.0, 1.0),
                      ("log_pop_mig_init_ratios", "normal", 0.0, 1.0)],
    # its gammas depend on a population's profile: score_dirichlet_prior
    "dirichlet_init": [*RAW_RATES, *_scales(10.0, 1.0, 1.0), RAW_TOTAL],
    "lognormal_init": [*RAW_RATES, *_scales(10.0, 10.0, 10.0), RAW_TOTAL, RAW_RATIOS],
    "lognormal_obs": [*RAW_RATES, *_scales(1.0, 10.0, 10.0), RAW_TOTAL, RAW_RATIOS],
    "uniform_init": [*RAW_RATES, *_scales(10.0, 10.0, 10.0), ("pop_0_true", "lognormal", 4.605170185988092, 0.3)],
}


def _all_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "v_draws1").unionByName(fixture(spark, sf_dir, "v_draws2")) \
        .unionByName(fixture(spark, sf_dir, "v_draws3"))


@register
def q_score_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(scoring.score_priors(_all_draws(spark, sf_dir), scoring.prior_spec(spark, PRIORS)))


@register
def q_score_model_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws named like the models' parameters under each model's own priors."""
    return round_doubles(scoring.score_models(fixture(spark, sf_dir, "v_params"),
                                              scoring.model_specs(spark, MODEL_PRIORS)))


@register
def q_score_dirichlet_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Dirichlet prior of the initial shares: gammas with a shape of factor times the population's own share."""
    d = common.draw_rows(spark, sf_dir)
    return round_doubles(d.select(*_DRAW, scoring.dirichlet_log_prior(
        "gamma_dirichlet", "profile", DIRICHLET_FACTOR).alias("log_prior")))


@register
def q_unmatched_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters without a prior of their own name: their values are not scored by it."""
    a = scoring.unmatched_parameters(_all_draws(spark, sf_dir), scoring.prior_spec(spark, PRIORS))
    every = sorted({row[0]: row for rows in MODEL_PRIORS.values() for row in rows}.values())
    b = scoring.unmatched_parameters(fixture(spark, sf_dir, "v_params"), scoring.prior_spec(spark, every))
    return a.union(b)


@register
def q_model_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record's observation and prior fields, one row per cell (i: observation, t: period, a: age)."""
    surv = common.survival(spark, sf_dir)
    mi = dims.model_input(surv, rates.align_fertility(common.fertility(spark, sf_dir), surv)).select("region")
    prof = rates.initial_age_profile(rates.age_shares(common.population(spark, sf_dir))).select(
        "region", F.col("profile").alias("pop_0_prop_data"))
    grid = survey.count_cohort_age(fixture(spark, sf_dir, "v_person"), common.survey_axes(spark, sf_dir))
    rec = mi.join(common.mig_share_matrix(spark, sf_dir), "region", "left").join(prof, "region", "left")
    rec = dims.with_observations(rec.withColumnRenamed("mig_props", "init_mig_pop_props_data"), {
        "pop_mig_obs": dims.to_matrix(grid, "mig_year", "age", "n").select("matrix").scalar(),
        "pop_native_obs": _vector(native_grid(spark, sf_dir)), "pop_obs": _vector(household_grid(spark, sf_dir)),
        "fert_hyper": F.lit(FERT_HYPER), "surv_hyper": F.lit(SURV_HYPER), "sd_init_ratios": F.lit(SD_INIT_RATIOS),
        "dirichlet_factor": F.lit(float(DIRICHLET_FACTOR))}, [T_OBS])
    one = lambda c: F.array(F.col(c).cast("double"))
    cubes = {  # every field as [i][t][a]
        "pop_mig_obs": F.col("pop_mig_obs"), "pop_native_obs": F.transform("pop_native_obs", lambda v: F.array(v)),
        "pop_obs": F.transform("pop_obs", lambda v: F.array(v)), "init_mig_pop_props_data": F.array("init_mig_pop_props_data"),
        "pop_0_prop_data": F.array(F.array("pop_0_prop_data")),
        "t_obs": F.transform("t_obs", lambda v: F.array(F.array(v.cast("double")))),
        **{c: F.array(F.array(one(c))) for c in ("n_obs", "fert_hyper", "surv_hyper", "sd_init_ratios", "dirichlet_factor")}}
    rows = rec.select("region", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c.alias("cube"))
                                                    for k, c in cubes.items()])).alias("f"))
    rows = common.explode_pos(rows.select("region", "f.field", "f.cube"), ["region", "field"], "cube", "_i", "_m")
    rows = common.explode_pos(rows, ["region", "field", "_i"], "_m", "_t", "_r")
    rows = common.explode_pos(rows, ["region", "field", "_i", "_t"], "_r", "_a", "value")
    return round_doubles(rows.select("region", "field", *[(F.col(f"_{c}") + 1).alias(c) for c in "ita"], "value"))


def _fert_summary(spark, sf_dir):
    s = _summary(spark, sf_dir, "v_draws2")
    return draws.extract_indexed(s, "fert", mappings=[("year", common.year_dim(spark, sf_dir)),
                                                      ("age", common.age_dim(spark, sf_dir))])


@register
def q_ribbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_fert_summary(spark, sf_dir).select("run_id", "year", "age", "q5", "q50", "q95"))


@register
def q_overlay_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates_ = common.fertility(spark, sf_dir)
    out = reports.overlay_rates(_fert_summary(spark, sf_dir).select("year", "age", "q5", "q50", "q95"),
                                rates_.select("region", "year", "age", "fert"), "fert")
    return round_doubles(out.select("region", "year", "age", "q5", "q50", "q95", "input_rate",
                                    "diff_q50", "inside_90"))


# ------------------------------------------------------------ slice 9: run store

from ..sources import draws_table, sampler, store  # noqa: E402


def _scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of this call's own under the shared store."""
    import uuid
    return f"{store.default_root(spark)}/{name}-{uuid.uuid4().hex}"


@register
def q_run_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write draws, summaries and mappings of all runs; read back; report."""
    root = _scratch(spark, sf_dir, "roundtrip")
    d = fixture(spark, sf_dir, "v_draws1")
    store.write_runs(spark, {"draws": d, "summary": draws.summarise_draws(d, probs=(0.05, 0.5, 0.95))}, root)
    store.write_mappings(spark, "included", [("year", common.year_dim(spark, sf_dir))], root)
    summaries = store.read_run(spark, "summary", root=root)
    rep = reports.scenario_report(summaries, store.read_mapping(spark, "included", "year", root))
    return round_doubles(rep)


@register
def q_sources_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader on written inputs: wide CSV, survey, lookup list, wide sampler CSV, report CSV.

    One row per source with its row count and a checksum of its numbers.
    """
    root = _scratch(spark, sf_dir, "sources")
    wide = fixture(spark, sf_dir, "v_pop_wide")
    wide.write.option("header", True).csv(f"{root}/wide")
    fixture(spark, sf_dir, "v_household").write.parquet(f"{root}/survey")
    fixture(spark, sf_dir, "v_list").write.option("header", True).csv(f"{root}/list")
    d = fixture(spark, sf_dir, "v_draws2").where(F.col("variable").startswith("fert["))
    names = [f"fert[{t},{a}]" for t in range(1, 7) for a in range(1, 9)]
    d.groupBy("run_id", "chain", "iteration").pivot("variable", names).agg(F.first("value")).write.partitionBy(
        "run_id").option("header", True).csv(f"{root}/draws")
    read = store.read_wide(spark, f"{root}/wide", columns=wide.columns, fmt="csv")
    pop = rates.tidy_rates(read, "pop").select(F.col("pop").alias("v"))
    hh = store.read_survey(spark, f"{root}/survey", "gender int, age string").select(
        F.col("age").try_cast("double").alias("v"))
    lst = store.read_lookup(spark, f"{root}/list").select(F.length("tribe_name").cast("double").alias("v"))
    back = store.read_draws(spark, f"{root}/draws", layout="wide", fmt="csv").select(
        F.col("value").alias("v"))
    out = None
    for name, df in (("wide", pop), ("survey", hh), ("lookup", lst), ("draws", back)):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).select(F.lit(name).alias("source"), "n", "total")
        out = row if out is None else out.unionByName(row)
    store.write_report(out, f"{root}/report", sort=["source"])
    rep = spark.read.schema("source string, n bigint, total double").option("header", True).csv(f"{root}/report")
    return round_doubles(rep, 3)


# The long headers of the population export, and their names here.
EXPORT_HEADERS = {"region": "Region, subregion, country or area *", "period": "Reference date (as of 1 July)"}


@register
def q_preamble_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The population table written as an export (notes above a header line with long names), read back and tidied."""
    path = _scratch(spark, sf_dir, "export")
    wide = fixture(spark, sf_dir, "v_pop_wide")
    bands = [c for c in wide.columns if c not in ("region", "period", "Variant", "Notes")]
    names = ["Index", "Variant", EXPORT_HEADERS["region"], "Notes", "Country code", EXPORT_HEADERS["period"], *bands]
    number = F.regexp_extract("region", "([0-9]+)$", 1).try_cast("int")
    wide.select(F.coalesce(number, F.lit(0)).alias("Index"), "Variant", "region", "Notes", F.lit("900"), "period",
                *[F.col(f"`{b}`") for b in bands]).write.csv(path)
    header = ",".join(f'"{n}"' if "," in n else n for n in names)
    notes = [F.lit("Population by age"), F.lit("File POP/1, notes, and more notes"), F.lit(",,,"), F.lit(header)]
    spark.range(1).select(F.explode(F.array(*notes)).alias("value")).write.mode("append").text(path)
    read = store.read_numbered_wide(spark, path, rename={v: k for k, v in EXPORT_HEADERS.items()})
    return round_doubles(rates.tidy_rates(read.drop("Index", "Country code"), "pop"))


@register
def q_sampler_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws written as sampler files (a text file per chain, comments, one column per variable) and read back by header."""
    path = _scratch(spark, sf_dir, "sampler")
    sampler.write_sampler(fixture(spark, sf_dir, "v_draws2"), path)
    run = sampler.read_sampler(spark, path)
    sums = run.draws.groupBy("run_id", "var_id").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("chain")).alias("by_chain"))
    out = sums.join(run.dictionary, ["run_id", "var_id"])
    return round_doubles(out.select("run_id", "base", F.get("indices", 0).alias("t"), F.get("indices", 1).alias("a"),
                                    "n", "total", "by_chain"))


def bucketed(spark: SparkSession, sf_dir: str, view: str) -> str:
    """The view's draws as a bucketed table; its name."""
    import uuid
    name = f"d_{uuid.uuid4().hex}"
    draws_table.open_table(spark, name, _scratch(spark, sf_dir, "table"))
    draws_table.write_runs(spark, name, draws_table.keyed(fixture(spark, sf_dir, view)))
    return name


@register
def q_summarise_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full summary from a bucketed table: no exchange of draws (the same rows as summarise_full)."""
    out = draws_table.summarise(spark, bucketed(spark, sf_dir, "v_draws1"), diagnostics=True)
    return round_doubles(out.drop("var_id", "base", "indices"))


@register
def q_extract_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parameter's labelled summary by the dictionary's indices; other parameters' folders are not read."""
    out = draws_table.extract(spark, bucketed(spark, sf_dir, "v_draws2"), "fert", ["year", "age"], probs=(0.05, 0.5, 0.95),
                              mappings={"year": common.year_dim(spark, sf_dir), "age": common.age_dim(spark, sf_dir)})
    return round_doubles(out.drop("variable"))


@register
def q_summarise_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' full summary: mean, sd, 9 quantiles, R-hat, bulk/tail ESS."""
    return round_doubles(draws.summarise_draws(fixture(spark, sf_dir, "v_draws1"), diagnostics=True))
