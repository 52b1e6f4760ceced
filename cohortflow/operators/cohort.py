"""Cohort-component projection as array expressions on (population, draw) rows.

One row carries one posterior draw of one population: the rate matrices
(``array<array<double>>`` indexed [period][age]) and the draw's raw
parameters. A draw never needs another draw, so every operator here is a
column expression: no exchange, no Python. Higher-order functions are
interpreted by the JVM, not compiled into the generated stage code. T and K stay data (array lengths), so the expression tree does not
grow with them.

Index conventions (1-based, K age groups): survival and fertility rows
carry K + 1 entries, the last one 0 (survival of the open age group);
``reprod[a] = step/2 * s[1] * prop_f * (f[a] + f[a+1] * s[a+1])``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import arr_dot, arr_sum, inv_logit, let, log0, logit, normalise, nullable_array, softmax, zeros


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _at(arr: Column, i) -> Column:
    """1-based element access (i a Column or int); NULL beyond the end."""
    return F.try_element_at(arr, i if isinstance(i, Column) else F.lit(int(i)))


def transform_rates(mean, link: str) -> Column:
    """Prior means on the model scale: 'logit' for survival, 'log' for fertility (infinite at 0 and 1)."""
    fn = logit if link == "logit" else log0
    return F.transform(_c(mean), lambda row: F.transform(row, lambda v: fn(v)))


def survival_from_draw(surv_mean, raw, sigma) -> Column:
    """surv[t] = inv_logit(logit(mean[t]) + raw[t] * sigma), then a trailing 0."""
    sigma = _c(sigma)
    return F.zip_with(transform_rates(surv_mean, "logit"), _c(raw), lambda row, rr: F.concat(
        F.zip_with(row, rr, lambda m, r: inv_logit(m + r * sigma)),
        F.array(F.lit(0.0))))


def fertility_from_draw(fert_mean, raw, sigma, before, after) -> Column:
    """fert[t] = [0]*before ++ exp(log(mean[t]) + raw[t] * sigma) ++ [0]*(after+1)."""
    sigma = _c(sigma)
    return F.zip_with(transform_rates(fert_mean, "log"), _c(raw), lambda row, rr: F.concat(
        zeros(_c(before)),
        F.zip_with(row, rr, lambda m, r: F.exp(m + r * sigma)),
        zeros(_c(after) + 1)))


def reproduction_row(surv_t: Column, fert_t: Column, prop_f, half_step: float = 2.5) -> Column:
    """First Leslie row for one period (K entries from K+1 rates)."""
    k = F.size(surv_t) - 1
    pf = _c(prop_f)
    s1 = _at(surv_t, 1)
    return F.transform(F.sequence(F.lit(1), k), lambda a: F.lit(half_step) * s1 * pf * (
        _at(fert_t, a) + _at(fert_t, a + 1) * _at(surv_t, a + 1)))


def reproduction(surv, fert, prop_f, half_step: float = 2.5) -> Column:
    """reprod[t] for every period."""
    return F.zip_with(_c(surv), _c(fert), lambda s, f: reproduction_row(s, f, prop_f, half_step))


def leslie_step(pop: Column, surv_t: Column, reprod_t: Column | None) -> Column:
    """One projection step: births into age 1, survivors of a move to a + 1.

    ``reprod_t=None`` gives the matrix without births (migrant cohorts).
    The open top group keeps ``s[K+1] * pop[K]`` (0 with the model's rates).
    """
    k = F.size(pop)
    births = arr_dot(reprod_t, pop) if reprod_t is not None else F.lit(0.0)
    return F.transform(F.sequence(F.lit(1), k), lambda a: F.when(a == 1, births).otherwise(
        _at(surv_t, a) * _at(pop, a - 1)
        + F.when(a == k, _at(surv_t, k + 1) * _at(pop, k)).otherwise(F.lit(0.0))))


def project_closed(pop0, surv, reprod, rate_offset: int = 1) -> Column:
    """pop[1] = pop0; pop[t] = L[t - rate_offset] · pop[t - 1] for t = 2..T.

    ``rate_offset`` 1 uses the previous period's rates (log-normal and
    disaggregated models), 0 the current period's (Dirichlet, uniform,
    log-normal-observation models).
    """
    surv, reprod = _c(surv), _c(reprod)
    T = F.size(surv)
    return F.aggregate(
        F.sequence(F.lit(2), F.greatest(T, F.lit(2))),
        F.array(nullable_array(_c(pop0))),
        lambda acc, t: F.when(t <= T, F.concat(acc, F.array(leslie_step(
            F.element_at(acc, -1), _at(surv, t - rate_offset), _at(reprod, t - rate_offset))))).otherwise(acc))


def leslie_entries(surv_t: Column, reprod_t: Column, births: bool = True) -> Column:
    """Structural entries of one Leslie matrix as (row, col, value) structs; without births the first row has none."""
    k = F.size(reprod_t)
    first = F.transform(F.sequence(F.lit(1), k), lambda c: F.struct(
        F.lit(1).alias("row"), c.alias("col"), _at(reprod_t, c).alias("value")))
    sub = F.transform(F.sequence(F.lit(2), k), lambda r: F.struct(
        r.alias("row"), (r - 1).alias("col"), _at(surv_t, r).alias("value")))
    top = F.array(F.struct(k.alias("row"), k.alias("col"), _at(surv_t, k + 1).alias("value")))
    return F.concat(first, sub, top) if births else F.concat(sub, top)


# ---------------------------------------------------------------- initial populations

def initial_total(raw, scale: float = 0.7, centre: float = 7.0) -> Column:
    """exp(centre + scale * raw)."""
    return F.exp(F.lit(centre) + F.lit(scale) * _c(raw))


def log_ratio_reference(props, ref: int = 10) -> Column:
    """log(p / p[ref]) of a share vector (reference index 10 in the models)."""
    return let(_c(props), lambda p: let(_at(p, ref), lambda base: F.transform(p, lambda v: F.ln(v / base))))


def shares_softmax(raw, props, sd: float | Column = 1.0, ref: int = 10) -> Column:
    """softmax(raw * sd + log(p / p[ref]))."""
    sd = sd if isinstance(sd, Column) else F.lit(float(sd))
    return softmax(F.zip_with(_c(raw), log_ratio_reference(props, ref), lambda r, l: r * sd + l))


def shares_gamma(gammas) -> Column:
    """Dirichlet shares by normalising gamma draws."""
    return normalise(gammas)


def scale_vector(v, k) -> Column:
    return let(_c(k), lambda by: F.transform(_c(v), lambda x: x * by))


# ---------------------------------------------------------------- disaggregated model

def zero_after(totals, t_obs) -> Column:
    """No new migrants after the last observed period (skipped if t_obs = 0)."""
    t_obs = _c(t_obs)
    return F.transform(_c(totals), lambda v, i: F.when((t_obs > 0) & (i + 1 > t_obs), F.lit(0.0)).otherwise(v))


def migrant_starts(totals, shares) -> Column:
    """Arrival vector of every cohort: total[m] x shares[m] ([mig_year][age])."""
    totals, shares = _c(totals), _c(shares)
    # zip_with evaluates each argument once; indexing ``shares`` inside a
    # lambda would re-evaluate it per cohort once Catalyst inlines it
    return F.zip_with(totals, F.slice(shares, 1, F.size(totals)),
                      lambda tot, sh: F.transform(sh, lambda x: x * tot))


def survivorship(surv) -> Column:
    """[t][a] of (l, z): survival accumulated along the cell's diagonal, a segmented running product.

    A diagonal (t, a), (t + 1, a + 1), ... follows people who age together.
    ``l`` is the product of their survival since the diagonal's first cell
    (period 1 or age 1), begun anew at 1 after a survival of 0, which ``z``
    counts. So the share of a cell's people alive in a later cell of the same
    diagonal is the ratio of the two ``l`` if both have the same ``z``, else 0.
    """
    surv = _c(surv)
    k = F.size(_at(surv, 1)) - 1
    cell = lambda l, z: F.struct(l.alias("l"), z.alias("z"))
    first = F.transform(F.sequence(F.lit(1), k), lambda a: cell(F.try_add(F.lit(1.0), F.lit(0.0)), F.lit(0)))

    def step(before, s):
        def at(a):
            old, rate = _at(before, a - 1), _at(s, a)
            return F.when(a == 1, cell(F.try_add(F.lit(1.0), F.lit(0.0)), F.lit(0))).when(
                rate == 0, cell(F.try_add(F.lit(1.0), F.lit(0.0)), old["z"] + 1)).otherwise(cell(old["l"] * rate, old["z"]))
        return F.transform(F.sequence(F.lit(1), k), at)

    return F.aggregate(F.slice(surv, 1, F.size(surv) - 1), F.array(first),
                       lambda acc, s: F.concat(acc, F.array(step(F.element_at(acc, -1), s))))


def _alive(grid: Column, m: Column, t: Column, a: Column) -> Column:
    """Share of the people aged ``a`` in period ``m`` who are alive (and t - m ages older) in period ``t``."""
    then, now = _at(_at(grid, m), a), _at(_at(grid, t), a + (t - m))
    return F.when(then["z"] == now["z"], now["l"] / then["l"]).otherwise(
        F.when(now["l"].isNotNull() & then["l"].isNotNull(), F.lit(0.0)))


def cohorts_at(starts, grid, t) -> Column:
    """Migrant cohorts [mig_year][age] in period ``t``: arrivals times survival along their diagonals.

    ``starts`` and ``grid`` (see :func:`survivorship`) should be materialised
    columns. The open age group must not survive (the models' rates end with
    0). NULL where an input is; 0 before arrival.
    """
    starts, grid, t = _c(starts), _c(grid), t if isinstance(t, Column) else F.lit(t)

    def cohort(start, i):
        m = i + 1
        return F.transform(start, lambda _, j: F.when((m > t) | (j < t - m), F.lit(0.0)).otherwise(
            _at(start, j + 1 - (t - m)) * _alive(grid, m, t, j + 1 - (t - m))))

    return F.transform(starts, cohort)


def cohort_sizes(starts, grid) -> Column:
    """[mig_year][t]: the size of every cohort in every period (0 before arrival)."""
    starts, grid = _c(starts), _c(grid)
    periods = F.sequence(F.lit(1), F.size(starts))

    def size(start, m, t):
        left = F.size(start) - (t - m)  # ages at arrival that have not left the open group
        ages = F.when(left > 0, F.sequence(F.lit(1), left)).otherwise(F.array().cast("array<int>"))
        return F.when(t < m, F.lit(0.0)).otherwise(F.aggregate(
            ages, F.try_add(F.lit(0.0), F.lit(0.0)), lambda acc, a: acc + _at(start, a) * _alive(grid, m, t, a)))

    return F.transform(starts, lambda start, i: F.transform(periods, lambda t: size(start, i + 1, t)))


def pooled_migrants(starts, surv) -> Column:
    """[t][a]: all migrants together. Cohorts age under the same rates, so their sum does too: T x K numbers, no cohort."""
    starts, surv = _c(starts), _c(surv)
    return F.aggregate(
        F.arrays_zip(F.slice(starts, 2, F.size(starts)).alias("start"), F.slice(surv, 1, F.size(starts) - 1).alias("s")),
        F.array(nullable_array(_at(starts, 1))),
        lambda acc, x: F.concat(acc, F.array(F.zip_with(
            leslie_step(F.element_at(acc, -1), x["s"], None), x["start"], lambda p, n: p + n))))


def migrant_births(pooled, reprod) -> Column:
    """births[t] = reprod[t-1] · migrants[t-1] (0 at t = 1), from all migrants together."""
    pooled, reprod = _c(pooled), _c(reprod)
    return F.transform(reprod, lambda _, i: F.when(i == 0, F.lit(0.0)).otherwise(
        arr_dot(_at(reprod, i), _at(pooled, i))))


def project_native(births, surv, reprod, k) -> Column:
    """Native-born: 0 at t = 1, then L[t-1] · pop + births[t] into age 1."""
    births, surv, reprod = _c(births), _c(surv), _c(reprod)
    T = F.size(births)
    return F.aggregate(
        F.sequence(F.lit(2), F.greatest(T, F.lit(2))),
        F.array(nullable_array(zeros(_c(k)))),
        lambda acc, t: F.when(t <= T, F.concat(acc, F.array(F.transform(
            leslie_step(F.element_at(acc, -1), _at(surv, t - 1), _at(reprod, t - 1)),
            lambda v, i: v + F.when(i == 0, _at(births, t)).otherwise(F.lit(0.0))))))
        .otherwise(acc))


def totals(native, pooled) -> Column:
    """Per period: struct(native, migrant) population."""
    return F.zip_with(_c(native), _c(pooled), lambda n, m: F.struct(
        arr_sum(n).alias("native"), arr_sum(m).alias("migrant"))).alias("totals")
