"""Scoring draws: observation composition and log densities.

Observation scores are evaluated in-row on (population, draw) rows (the
observed vector is attached once per population); prior scores join the long
draws table to a small prior-spec table on the parameter name and sum the
densities per draw with one ``groupBy``. Densities are normalised (Stan's
``~`` drops constants), so compare differences between draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import log_gamma
from .draws import base_name

LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_lpdf(x, mu, sigma) -> Column:
    x, mu, sigma = _c(x), _c(mu), _c(sigma)
    z = (x - mu) / sigma
    return F.lit(-LOG_SQRT_2PI) - F.ln(sigma) - F.lit(0.5) * z * z


_NEVER = float("-inf")  # log density outside the support


def lognormal_lpdf(x, mu, sigma) -> Column:
    """LogNormal(mu, sigma) log density; -Infinity for x <= 0."""
    x = _c(x)
    return F.when(x <= 0, F.lit(_NEVER)).otherwise(normal_lpdf(F.ln(x), mu, sigma) - F.ln(x))


def half_normal_lpdf(x, sigma) -> Column:
    """Normal(0, sigma) restricted to x >= 0 (density doubled); -Infinity for x < 0."""
    return F.when(_c(x) < 0, F.lit(_NEVER)).otherwise(F.lit(math.log(2.0)) + normal_lpdf(x, F.lit(0.0), sigma))


def gamma_lpdf(x, alpha, lgamma_alpha, beta=1.0) -> Column:
    """Gamma(alpha, beta) log density, ``lgamma_alpha`` = log Gamma(alpha); -Infinity for x <= 0."""
    x, alpha = _c(x), _c(alpha)
    b = beta if isinstance(beta, Column) else F.lit(float(beta))
    return F.when(x <= 0, F.lit(_NEVER)).otherwise(
        alpha * F.ln(b) + (alpha - 1) * F.ln(x) - b * x - _c(lgamma_alpha))


def composition(obs: DataFrame, keys: Sequence[str], value: str = "n", order: str = "age",
                ref: int = 10) -> DataFrame:
    """Observation total, shares and log-ratios to the ``ref``-th age.

    Window aggregates over each observation's key (no join back).
    """
    w = Window.partitionBy(*keys)
    wo = w.orderBy(order)
    out = obs.withColumns({
        "total": F.sum(value).over(w),
        "_pos": F.row_number().over(wo),
    })
    out = out.withColumn("share", F.try_divide(F.col(value), F.col("total")))
    ref_share = F.max(F.when(F.col("_pos") == ref, F.col("share"))).over(w)
    out = out.withColumn("log_ratio", F.ln(F.try_divide(F.col("share"), ref_share)))
    return out.drop("_pos")


def score_normal(obs, pop, sigma) -> Column:
    """sum_a Normal(obs[a] | pop[a], sigma) over two arrays."""
    sigma = _c(sigma)
    terms = F.zip_with(_c(obs), _c(pop), lambda o, p: normal_lpdf(o, p, sigma))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def score_lognormal_composition(obs, pop, sigma, ref: int = 10) -> Column:
    """LogNormal(total_obs | log total_true, sigma) + sum Normal(log-ratio_obs | log-ratio_true, 1)."""
    obs, pop, sigma = _c(obs), _c(pop), _c(sigma)

    def total(v):
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

    def ratios(v):
        t = total(v)
        return F.transform(v, lambda x: F.ln((x / t) / (F.element_at(v, ref) / t)))

    head = lognormal_lpdf(total(obs), F.ln(total(pop)), sigma)
    terms = F.zip_with(ratios(obs), ratios(pop), lambda o, p: normal_lpdf(o, p, F.lit(1.0)))
    return head + F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def over_observations(t_obs, score) -> Column:
    """Sum of ``score(t)`` over the observed periods; 0 if the first is 0 (no observation)."""
    t_obs = _c(t_obs)
    total = F.aggregate(t_obs, F.lit(0.0), lambda acc, t: acc + score(t))
    return F.when(F.try_element_at(t_obs, F.lit(1)) > 0, total).otherwise(F.lit(0.0))


def prior_spec(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Prior table: (param, family, p1, p2); family in normal, half_normal,
    lognormal, gamma. ``param`` is a parameter's name (all its indices) or a
    full variable name such as ``x[3]``, which goes before the name's row.
    ``lgamma_p1`` is filled here for gamma priors."""
    data = [(p, fam, float(a), float(b), math.lgamma(a) if fam == "gamma" else None)
            for p, fam, a, b in rows]
    return spark.createDataFrame(data, "param string, family string, p1 double, p2 double, lgamma_p1 double")


def with_priors(draws: DataFrame, spec: DataFrame) -> DataFrame:
    """Every draw with its prior's columns, NULL where there is none.

    The spec is built from a caller's list (one row per parameter or index),
    so its size is that list's; broadcasting it keeps the skewed key (a few
    parameters own all draws) out of a shuffle join.
    """
    own = spec.select(F.col("param").alias("variable"), F.struct("family", "p1", "p2", "lgamma_p1").alias("_own"))
    named = spec.select(F.col("param").alias("_name"), F.struct("family", "p1", "p2", "lgamma_p1").alias("_named"))
    d = draws.withColumn("_name", base_name())
    d = d.join(F.broadcast(own), "variable", "left").join(F.broadcast(named), "_name", "left")
    return d.withColumn("_prior", F.coalesce("_own", "_named")).select(
        *draws.columns, F.col("_name").alias("param"), "_prior.*")


def density(value: str) -> Column:
    """Log density of ``value`` under the prior in the row's columns family, p1, p2, lgamma_p1."""
    return (F.when(F.col("family") == "normal", normal_lpdf(value, "p1", "p2"))
             .when(F.col("family") == "half_normal", half_normal_lpdf(value, "p2"))
             .when(F.col("family") == "lognormal", lognormal_lpdf(value, "p1", "p2"))
             .when(F.col("family") == "gamma", gamma_lpdf(value, "p1", "lgamma_p1", F.col("p2"))))


def score_priors(draws: DataFrame, spec: DataFrame, by: Sequence[str] = ("run_id", "chain", "iteration")) -> DataFrame:
    """Prior log density per draw: look up the prior, evaluate, sum.

    A value outside its prior's support makes the sum -Infinity. Variables
    without a prior add nothing and are listed by :func:`unmatched_parameters`.
    """
    j = with_priors(draws, spec).where(F.col("family").isNotNull())
    dens = density("value")
    keys = [k for k in by if k in j.columns]
    return j.groupBy(*keys).agg(F.sum(dens).alias("log_prior"), F.count(dens).alias("n_terms"))


def model_specs(spark: SparkSession, models: dict[str, Sequence[tuple]]) -> DataFrame:
    """Prior tables of several models as one spec with a ``model`` column."""
    out = None
    for name, rows in models.items():
        part = prior_spec(spark, rows).select(F.lit(name).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def score_models(draws: DataFrame, specs: DataFrame, by: Sequence[str] = ("run_id", "chain", "iteration")) -> DataFrame:
    """Prior log density per draw under every model, in one pass over the draws.

    ``specs`` (see :func:`model_specs`) names parameters, not single indices;
    it is a caller's list, so it is broadcast. A parameter counts for the
    models that have a prior for it.
    """
    j = draws.withColumn("_name", base_name()).join(F.broadcast(specs.withColumnRenamed("param", "_name")), "_name")
    dens = density("value")
    keys = [k for k in by if k in draws.columns]
    return j.groupBy("model", *keys).agg(F.sum(dens).alias("log_prior"), F.count(dens).alias("n_terms"))


def dirichlet_log_prior(gammas, shares, factor: float) -> Column:
    """sum_a Gamma(factor * shares[a], 1) log density of ``gammas``: the Dirichlet prior of a population's own profile.

    NULL without a profile; -Infinity if a gamma is not positive.
    """
    term = lambda g, p: gamma_lpdf(g, p * float(factor), log_gamma(p * float(factor)))
    return F.aggregate(F.zip_with(_c(gammas), _c(shares), term), F.try_add(F.lit(0.0), F.lit(0.0)), lambda acc, v: acc + v)


def unmatched_parameters(draws: DataFrame, spec: DataFrame) -> DataFrame:
    """(param, n_values): parameters among the draws that have no prior."""
    return with_priors(draws, spec).where(F.col("family").isNull()).groupBy("param").agg(
        F.count(F.lit(1)).alias("n_values"))


def score_cohorts(obs_matrix, cohorts, native_obs, native) -> Column:
    """One observation of the disaggregated model: sum_m Normal(obs[m] | cohort[m], 1) + Normal(native_obs | native, 1).

    ``cohorts`` [m][a] and ``native`` [a] are those of the observed period.
    """
    mig = F.aggregate(
        F.zip_with(_c(obs_matrix), _c(cohorts), lambda o, c: score_normal(o, c, F.lit(1.0))),
        F.lit(0.0), lambda acc, v: acc + v)
    return mig + score_normal(_c(native_obs), _c(native), F.lit(1.0))
