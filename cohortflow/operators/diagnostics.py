"""Convergence diagnostics: rank-normalised split R-hat, bulk and tail ESS.

Definitions follow Vehtari, Gelman, Simpson, Carpenter and Bürkner (2021),
"Rank-normalization, folding, and localization: an improved R-hat".

Layout on Spark:

* every window is partitioned by the variable keys, so one exchange on
  ``(run_id, variable)`` serves splitting, ranking, medians and quantiles;
* R-hat is plain aggregation over split chains;
* ESS is one grouped map per variable (``applyInPandas``): NumPy FFT
  autocovariance per split chain and Geyer's initial monotone sequence,
  vectorised. A group is one variable's draws (chains x iterations, a
  sampler setting, never the number of variables, which is where volume
  grows), and it reuses the exchange of the rank windows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import norm_ppf_sql

# The grouped-map function below and the helpers it calls travel to the
# executors by value, so workers need NumPy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _keys(draws: DataFrame, by: Sequence[str] | None) -> list[str]:
    return list(by or [c for c in ("run_id", "variable") if c in draws.columns])


def split_chains(draws: DataFrame, by: Sequence[str] | None = None, clustered: bool = False) -> DataFrame:
    """Split every chain into its first and last floor(n/2) draws.

    ``clustered`` says that the draws come bucketed by the variable, so they
    need no exchange.

    Adds ``sc`` (split chain, 1-based), ``pos`` (1-based position in it),
    ``n_half`` and per-variable statistics of the unsplit draws that later
    steps need: ``median``, ``q05``, ``q95``, ``is_const``, ``all_finite``.
    The middle draw of an odd-length chain is dropped after those
    statistics are taken.
    """
    by = _keys(draws, by)
    wv = Window.partitionBy(*by)
    wc = Window.partitionBy(*by, "chain")
    # one exchange on the variable keys serves every later window, grouping
    # and join of R-hat and ESS (all are keyed by a superset of them)
    d = draws.select(*by, "chain", "iteration", F.col("value").cast("double").alias("value"))
    if not clustered:
        d = d.repartition(*by)
    d = d.withColumns({
        "_r": F.row_number().over(wc.orderBy("iteration")),
        "_n": F.count(F.lit(1)).over(wc),
        "_q": F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).over(wv),
        "is_const": (F.min("value").over(wv) == F.max("value").over(wv)),
        "all_finite": F.bool_and(F.col("value").isNotNull() & ~F.isnan("value")
                                 & (F.abs("value") != float("inf"))).over(wv),
        "_chains": F.dense_rank().over(wv.orderBy("chain")),
    })
    half = F.floor(F.col("_n") / 2).cast("int")
    first = F.col("_r") <= half
    second = F.col("_r") > F.col("_n") - half
    d = d.where(first | second)
    return d.select(
        *by, "value",
        F.when(first, 2 * F.col("_chains") - 1).otherwise(2 * F.col("_chains")).alias("sc"),
        F.when(first, F.col("_r")).otherwise(F.col("_r") - (F.col("_n") - half)).alias("pos"),
        half.alias("n_half"),
        F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q05"), F.col("_q")[2].alias("q95"),
        "is_const", "all_finite",
    )


def _avg_rank(col: str, by: list[str]):
    w = Window.partitionBy(*by).orderBy(col)
    upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(w) + upto) / F.lit(2.0)


def rank_normalise(split: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """z = Phi^-1((r - 3/8) / (S + 1/4)) of the value and of |value - median|.

    ``r`` is the average rank over all split draws of the variable (ties
    share their mean rank), S their number.
    """
    by = _keys(split, by)
    s = split.withColumns({
        "_fold": F.abs(F.col("value") - F.col("median")),
        "_S": F.count(F.lit(1)).over(Window.partitionBy(*by)),
    })
    s = s.withColumns({"_rb": _avg_rank("value", by), "_rf": _avg_rank("_fold", by)})
    s = s.withColumns({
        "_pb": (F.col("_rb") - 0.375) / (F.col("_S") + 0.25),
        "_pf": (F.col("_rf") - 0.375) / (F.col("_S") + 0.25),
    })
    return s.withColumns({"z": F.expr(norm_ppf_sql("_pb")), "zf": F.expr(norm_ppf_sql("_pf"))}) \
            .drop("_pb", "_pf", "_rb", "_rf", "_fold")


def _rhat_of(col: str):
    """Aggregates (over split-chain rows) giving split R-hat of ``col``."""
    n = F.max("_n")  # equal for every split chain, else the result is NULL
    w = F.avg(f"_var_{col}")
    b = n * F.var_samp(f"_mean_{col}")
    return F.sqrt((F.try_divide(b, w) + n - 1) / n)


def rhat(draws: DataFrame, by: Sequence[str] | None = None, normalised: DataFrame | None = None) -> DataFrame:
    """max(R-hat of rank-normalised split draws, R-hat of the folded ones).

    NULL for constant or non-finite variables, and for variables whose split
    chains differ in length (listed by :func:`unequal_chains`).
    """
    by = _keys(draws, by)
    z = normalised if normalised is not None else rank_normalise(split_chains(draws, by), by)
    per_chain = z.groupBy(*by, "sc").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("z").alias("_mean_z"), F.var_samp("z").alias("_var_z"),
        F.avg("zf").alias("_mean_zf"), F.var_samp("zf").alias("_var_zf"),
        F.bool_or("is_const").alias("_const"), F.bool_and("all_finite").alias("_finite"),
    )
    out = per_chain.groupBy(*by).agg(
        _rhat_of("z").alias("_rb"), _rhat_of("zf").alias("_rf"),
        F.bool_or("_const").alias("_const"), F.bool_and("_finite").alias("_finite"),
        (F.min("_n") == F.max("_n")).alias("_equal"))
    good = ~F.col("_const") & F.col("_finite") & F.col("_equal")
    return out.select(*by, F.when(good, F.greatest("_rb", "_rf")).alias("rhat"))


def unequal_chains(draws: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Variables whose split chains differ in length, with the shortest and longest chain.

    R-hat and ESS need equal split chains; for these variables they are NULL.
    """
    by = _keys(draws, by)
    n = draws.groupBy(*by, "chain").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy(*by).agg(F.min("n").alias("shortest"), F.max("n").alias("longest"))
    return out.where(F.floor(F.col("shortest") / 2) != F.floor(F.col("longest") / 2))


# ---------------------------------------------------------------- ESS

def autocovariance(x: np.ndarray) -> np.ndarray:
    """Biased autocovariance (divisor n) of every lag, by FFT."""
    n = len(x)
    m = 1
    while m < 2 * n:
        m *= 2
    f = np.fft.rfft(x - x.mean(), m)
    return np.fft.irfft(f * np.conjugate(f), m)[:n] / n


def geyer_ess(chains: list[np.ndarray]) -> float | None:
    """ESS of equal-length split chains: Geyer's initial positive sequence
    on pair sums, made monotone, truncated at the first non-positive pair
    (or at lag n - 5), tau >= 1 / log10(S)."""
    m, n = len(chains), len(chains[0]) if chains else 0
    if n < 3 or any(len(c) != n for c in chains):
        return None
    x = np.vstack(chains)
    if np.all(x == x.flat[0]):
        return None
    acov = np.vstack([autocovariance(row) for row in x])
    mean_var = acov[:, 0].mean() * n / (n - 1)
    var_plus = mean_var * (n - 1) / n + (x.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = 1.0 - (mean_var - acov.mean(axis=0)) / var_plus
    rho[0] = 1.0
    npairs = n // 2
    pairs = rho[0:2 * npairs:2] + rho[1:2 * npairs:2]
    bound = max(0, math.ceil((n - 5) / 2))
    stop = np.flatnonzero(~(pairs > 0))
    kstop = min(int(stop[0]) if len(stop) else bound, bound)
    even = rho[2 * kstop]
    last = even if pairs[kstop] >= 0 else (even if even > 0 else 0.0)
    tau = -1.0 + 2.0 * np.minimum.accumulate(pairs[:kstop]).sum() + last
    S = m * n
    return float(S / max(tau, 1.0 / math.log10(S)))


def _ess_schema(by: list[str], types: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(k, types[k]) for k in by]
                        + [T.StructField("ess_bulk", T.DoubleType()), T.StructField("ess_tail", T.DoubleType())])


def _ess_fn(by: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sc", "pos"])
        bad = bool(pdf["is_const"].any()) or not bool(pdf["all_finite"].all())
        groups = [g for _, g in pdf.groupby("sc", sort=True)]
        out = {k: [pdf[k].iloc[0]] for k in by}
        if bad:
            out.update(ess_bulk=[None], ess_tail=[None])
            return pd.DataFrame(out)
        bulk = geyer_ess([g["z"].to_numpy("float64") for g in groups])
        lo = geyer_ess([(g["value"] <= g["q05"]).to_numpy("float64") for g in groups])
        hi = geyer_ess([(g["value"] <= g["q95"]).to_numpy("float64") for g in groups])
        out.update(ess_bulk=[bulk], ess_tail=[None if lo is None or hi is None else min(lo, hi)])
        return pd.DataFrame(out)
    return run


def ess(draws: DataFrame, by: Sequence[str] | None = None, normalised: DataFrame | None = None) -> DataFrame:
    """Bulk ESS (rank-normalised split draws) and tail ESS (min over the
    5 % and 95 % quantile indicators).

    One grouped map per variable after the shared rank-normalisation: the
    group is the variable's split chains (chains x iterations, a sampler
    setting, not a data volume); each chain's autocovariance comes from one
    FFT. Output keeps no other columns, so nothing is re-shuffled.
    """
    by = _keys(draws, by)
    z = normalised if normalised is not None else rank_normalise(split_chains(draws, by), by)
    cols = z.select(*by, "sc", "pos", "z", "value", "q05", "q95", "is_const", "all_finite")
    types = {f.name: f.dataType for f in z.schema.fields}
    return cols.groupBy(*by).applyInPandas(_ess_fn(by), _ess_schema(by, types))


def convergence(draws: DataFrame, by: Sequence[str] | None = None, clustered: bool = False) -> DataFrame:
    """rhat, ess_bulk, ess_tail per variable from one shared preparation."""
    by = _keys(draws, by)
    z = rank_normalise(split_chains(draws, by, clustered), by)
    return rhat(draws, by, normalised=z).join(ess(draws, by, normalised=z), by, "full")
