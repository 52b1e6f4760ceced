"""R-hat and ESS of variables of any size: no task holds a variable or a chain.

* Positions in a chain and ranks among a variable's values come from range
  partitions with offsets (:mod:`operators.ordering`); equal values are
  counted first, so ties get their mean rank wherever the borders fall.
* Autocovariances are summed over overlapping segments of a chain: a segment
  adds up the products of its own draws with those up to ``lags`` places
  ahead, and the sums of all segments are the chain's. Only as many lags are
  taken as Geyer's sequence needs: variables that it doesn't end within the
  limit go through another round with four times the lags.

The results are those of :mod:`operators.diagnostics`, whose windows and FFT
are cheaper for a sampler's usual runs.
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
from ..session import settle
from .draws import bracketed_quantiles, quantile_name
from .ordering import numbered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# draws of a chain that one task sums up at once, and the lags of the first round
SEGMENT, FIRST_LAGS = 1 << 16, 64
SERIES = ("bulk", "q05", "q95")


def _keys(draws: DataFrame, by: Sequence[str] | None) -> list[str]:
    return list(by or [c for c in ("run_id", "variable") if c in draws.columns])


def mean_ranks(df: DataFrame, by: Sequence[str], value: str, rank: str = "rank", size: str = "size") -> DataFrame:
    """(by, value, rank, size): the mean rank of each distinct value among its group's rows, and the group's rows."""
    tied = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = numbered(tied, by, [value], weight="_c", before="_before", total=size)
    return placed.select(*by, value, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(rank), size)


def split_halves(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, sc, pos, value, n_half) and the statistics of the unsplit draws, for chains of any length.

    ``pos`` counts from 0; ``sc`` is NULL for the middle draw of an odd
    chain, which belongs to neither half.
    """
    d = draws.select(*by, "chain", "iteration", F.col("value").cast("double").alias("value"))
    d = numbered(d, [*by, "chain"], ["iteration", "value"], before="_r", total="_n")
    half = F.floor(F.col("_n") / 2)
    second = F.col("_r") >= F.col("_n") - half
    return d.select(*by, "value", half.alias("n_half"),
                    F.when(F.col("_r") < half, 2 * F.col("chain")).when(second, 2 * F.col("chain") + 1).alias("sc"),
                    F.when(second, F.col("_r") - (F.col("_n") - half)).otherwise(F.col("_r")).alias("pos"))


def _matching(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Join on keys of which some may be NULL."""
    r = right.select(*[F.col(c).alias(f"_j{i}") if c in names else F.col(c) for i, c in enumerate(right.columns)])
    on = F.lit(True)
    for i, c in enumerate(right.columns):
        if c in names:
            on = on & left[c].eqNullSafe(r[f"_j{i}"])
    return left.join(r, on).drop(*[c for c in r.columns if c.startswith("_j")])


def normalised(draws: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Split draws with z, zf and the columns that R-hat and ESS read, as ``rank_normalise`` gives them."""
    by = _keys(draws, by)
    d = settle(split_halves(draws, by))
    stats = d.groupBy(*by).agg(
        (F.min("value") == F.max("value")).alias("is_const"),
        F.bool_and(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))).alias("all_finite"))
    q = bracketed_quantiles(d, by, (0.05, 0.5, 0.95)).select(
        *by, *[F.col(quantile_name(p)).alias(n) for p, n in ((0.05, "q05"), (0.5, "median"), (0.95, "q95"))])
    stats = settle(stats.join(q, by, "left"))
    kept = _matching(d.where(F.col("sc").isNotNull()), stats, by)
    kept = settle(kept.withColumn("fold", F.abs(F.col("value") - F.col("median"))))
    z = _matching(kept, mean_ranks(kept, by, "value", "_rb", "_S"), [*by, "value"])
    z = _matching(z, mean_ranks(kept, by, "fold", "_rf", "_Sf"), [*by, "fold"])
    z = z.withColumns({"_pb": (F.col("_rb") - 0.375) / (F.col("_S") + 0.25),
                       "_pf": (F.col("_rf") - 0.375) / (F.col("_S") + 0.25)})
    return z.withColumns({"z": F.expr(norm_ppf_sql("_pb")), "zf": F.expr(norm_ppf_sql("_pf"))}).drop(
        "_pb", "_pf", "_rb", "_rf", "_S", "_Sf", "fold")


# ------------------------------------------------------------------ ESS

def segment_products(x: np.ndarray, body: int, lags: int) -> np.ndarray:
    """sum over i < body of x[i] * x[i + lag], lag = 0 .. lags (0 beyond the end), by FFT."""
    m = 1
    while m < len(x) + body:
        m *= 2
    f = np.fft.irfft(np.fft.rfft(x, m) * np.conjugate(np.fft.rfft(x[:body], m)), m)
    out = np.zeros(lags + 1)
    n = min(lags + 1, len(x))
    out[:n] = f[:n]
    return out


def _products_fn(by: list[str], lags: int, segment: int):
    def run(key, pdf):
        pdf = pdf.sort_values("pos")
        body = int((pdf["pos"] < (key[-1] + 1) * segment).sum())
        out = {k: [v] for k, v in zip([*by, "sc"], key)}
        for s in SERIES:
            out[s] = [segment_products((pdf[s] - pdf[f"mean_{s}"]).to_numpy("float64"), body, lags)]
        return pd.DataFrame(out)
    return run


def ess_from_lags(acov: list[float], n: int, m: int, mean_spread: float) -> tuple[float | None, bool]:
    """(ESS, decided) from the chains' mean autocovariances of the first lags.

    Not decided: the sequence of pair sums is still positive at the last lag.
    """
    if n < 3 or acov[0] <= 0 and mean_spread <= 0:
        return None, True
    mean_var = acov[0] * n / (n - 1)
    rho = 1.0 - (mean_var - np.array(acov)) / (acov[0] + mean_spread)
    rho[0] = 1.0
    pairs = rho[0:len(rho) // 2 * 2:2] + rho[1:len(rho) // 2 * 2:2]
    bound = max(0, math.ceil((n - 5) / 2))
    ended = np.flatnonzero(~(pairs > 0))
    if not len(ended) and bound >= len(pairs):
        return None, False
    stop = min(int(ended[0]) if len(ended) else bound, bound)
    even = rho[2 * stop]
    last = even if pairs[stop] >= 0 or even > 0 else 0.0
    tau = -1.0 + 2.0 * np.minimum.accumulate(pairs[:stop]).sum() + last
    total = m * n
    return float(total / max(tau, 1.0 / math.log10(total))), True


def _series(normal: DataFrame, by: list[str]) -> DataFrame:
    indicator = lambda q: (F.col("value") <= F.col(q)).cast("double")
    return normal.select(*by, "sc", "pos", F.col("z").alias("bulk"), indicator("q05").alias("q05"),
                         indicator("q95").alias("q95"))


def _round(x: DataFrame, chains: DataFrame, by: list[str], lags: int, segment: int) -> DataFrame:
    """(by, lag, bulk, q05, q95): autocovariances averaged over the split chains."""
    segment = max(segment, 4 * lags)
    # a draw belongs to its own segment, and as a look-ahead to the one before if it is among the first ``lags``
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - lags) / segment))
    rows = x.join(chains, [*by, "sc"]).withColumn("seg", F.explode(F.sequence(first, F.floor(F.col("pos") / segment))))
    schema = T.StructType([rows.schema[k] for k in [*by, "sc"]] + [T.StructField(s, T.ArrayType(T.DoubleType()))
                                                                   for s in SERIES])
    sums = rows.groupBy(*by, "sc", "seg").applyInPandas(_products_fn(by, lags, segment), schema)
    each = sums.select(*by, "sc", F.posexplode(F.arrays_zip(*SERIES)).alias("lag", "v"))
    total = each.groupBy(*by, "sc", "lag").agg(*[F.sum(f"v.{s}").alias(s) for s in SERIES])
    n = chains.select(*by, "sc", "n")
    return total.join(n, [*by, "sc"]).groupBy(*by, "lag").agg(*[F.avg(F.col(s) / F.col("n")).alias(s) for s in SERIES])


def _decide_fn(by: list[str]):
    def run(frames):
        for pdf in frames:
            out = {k: pdf[k] for k in by}
            for s in SERIES:
                got = [(None, True) if bad else ess_from_lags(list(a), int(n), int(m), spread)
                       for bad, a, n, m, spread in zip(pdf["skip"] | pdf[f"flat_{s}"], pdf[s], pdf["n"], pdf["m"],
                                                       pdf[f"spread_{s}"])]
                out[s] = [g[0] for g in got]
                out[f"ok_{s}"] = [g[1] for g in got]
            yield pd.DataFrame(out)
    return run


def ess(normal: DataFrame, by: Sequence[str], segment: int = SEGMENT, first_lags: int = FIRST_LAGS) -> DataFrame:
    """(by, ess_bulk, ess_tail) from :func:`normalised` draws."""
    by = list(by)
    x = settle(_series(normal, by))
    chains = x.groupBy(*by, "sc").agg(F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(f"mean_{s}") for s in SERIES],
                                      *[F.min(s).alias(f"min_{s}") for s in SERIES],
                                      *[F.max(s).alias(f"max_{s}") for s in SERIES])
    chains = settle(chains)
    flags = normal.groupBy(*by).agg(F.coalesce(F.bool_or("is_const") | ~F.bool_and("all_finite"), F.lit(True)).alias("_bad"))
    var = chains.groupBy(*by).agg(
        F.min("n").alias("n"), F.count(F.lit(1)).alias("m"), (F.min("n") != F.max("n")).alias("_uneven"),
        *[F.coalesce(F.var_samp(f"mean_{s}"), F.lit(0.0)).alias(f"spread_{s}") for s in SERIES],
        *[(F.min(f"min_{s}") == F.max(f"max_{s}")).alias(f"flat_{s}") for s in SERIES])
    var = settle(var.join(flags, by).withColumn("skip", F.col("_bad") | F.col("_uneven")).drop("_bad", "_uneven"))
    done, open_, lags = None, var, first_lags
    while True:
        longest = open_.agg(F.max("n")).first()[0]
        if longest is None:
            break
        lags = int(min(lags, max(longest - 1, 1)))
        ours = x.join(open_.where(~F.col("skip")).select(*by), by, "left_semi")
        acov = _round(ours, chains, by, lags, segment)
        # at most ``lags`` rows a variable
        curve = acov.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lag", *SERIES))).alias("c"))
        curve = open_.join(curve, by, "left").select(
            *open_.columns, *[F.coalesce(F.col(f"c.{s}"), F.array(F.lit(0.0))).alias(s) for s in SERIES])
        schema = T.StructType([open_.schema[k] for k in by])
        for s in SERIES:
            schema = schema.add(s, T.DoubleType()).add(f"ok_{s}", T.BooleanType())
        got = settle(curve.mapInPandas(_decide_fn(by), schema))
        # with every lag at hand there is nothing left to wait for
        ok = F.col("ok_bulk") & F.col("ok_q05") & F.col("ok_q95") | F.lit(lags >= longest - 1)
        part = got.where(ok).select(*by, F.col("bulk").alias("ess_bulk"), F.when(
            F.col("q05").isNotNull() & F.col("q95").isNotNull(), F.least("q05", "q95")).alias("ess_tail"))
        done = part if done is None else done.unionByName(part)
        open_ = settle(open_.join(got.where(~ok).select(*by), by, "left_semi"))
        if open_.isEmpty():
            break
        lags *= 4
    return done if done is not None else var.select(*by, F.lit(None).cast("double").alias("ess_bulk"),
                                                    F.lit(None).cast("double").alias("ess_tail"))


def convergence(draws: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """(by, rhat, ess_bulk, ess_tail) for variables of any size."""
    from .diagnostics import rhat
    by = _keys(draws, by)
    z = settle(normalised(draws, by))
    return rhat(draws, by, normalised=z).join(ess(z, by), by, "left")
