"""Posterior draws: long layout, summaries and labelled index extraction.

Draws are a long table ``(run_id, variable, chain, iteration, value)``.
Every summary is one ``groupBy`` over ``(run_id, variable)`` so all runs and
variables share a single exchange; no per-variable driver loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

# The quantile set requested by every run of the reference.
DEFAULT_PROBS = (0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975)


def quantile_name(p: float) -> str:
    """0.025 -> 'q2_5', 0.5 -> 'q50' (underscore: dots break column paths)."""
    text = f"{p * 100:.10g}"
    return "q" + text.replace(".", "_")


def draws_keys(draws: DataFrame) -> list[str]:
    return [c for c in ("run_id", "variable") if c in draws.columns]


def summarise_draws(draws: DataFrame, probs: Sequence[float] = DEFAULT_PROBS,
                    by: Sequence[str] | None = None, variables: Sequence[str] | None = None,
                    diagnostics: bool = False, exact: bool = True, accuracy: int = 100_000,
                    unbounded: bool = False) -> DataFrame:
    """mean, sd, type-7 quantiles per variable (NULL draws ignored).

    ``variables=None`` summarises everything (the reference's default);
    a list restricts the scan with an ``isin`` filter. With ``diagnostics``
    the rank-normalised R-hat and bulk/tail ESS are joined on the keys.
    Exact quantiles keep one variable's values in its aggregation buffer
    (a variable holds chains x iterations draws); ``exact=False`` switches
    to ``percentile_approx`` (bounded sketch). ``unbounded`` is for groups of
    any size: exact quantiles by :func:`bracketed_quantiles`, without a
    group's values in one buffer.
    """
    if unbounded:
        by = list(by or draws_keys(draws))
        rows = draws if variables is None else draws.where(F.col("variable").isin(list(variables)))
        stats = rows.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
        return stats.join(bracketed_quantiles(rows, by, probs, accuracy), by)
    by = list(by or draws_keys(draws))
    if variables is not None:
        draws = draws.where(F.col("variable").isin(list(variables)))
    pct_array = F.array(*[F.lit(float(p)) for p in probs])
    pct = F.percentile(F.col("value"), pct_array) if exact else \
        F.percentile_approx(F.col("value"), pct_array, accuracy)
    out = draws.groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        pct.alias("_q"),
    )
    qcols = [F.col("_q")[i].alias(quantile_name(p)) for i, p in enumerate(probs)]
    out = out.select(*by, "mean", "sd", *qcols)
    if diagnostics:
        from .diagnostics import convergence
        out = out.join(convergence(draws, by=by), on=by, how="left")
    return out


# distinct values of a bracket that one task may order, and the cells of a refining round
BRACKET_VALUES, CELLS = 20_000, 64


def bracketed_quantiles(draws: DataFrame, by: Sequence[str], probs: Sequence[float],
                        accuracy: int = 100_000, bound: int = BRACKET_VALUES) -> DataFrame:
    """Exact type-7 quantiles of groups of any size.

    A bounded sketch (rank error at most n / accuracy) brackets every
    quantile. While a bracket holds more than ``bound`` distinct values it is
    cut into cells of about equal weight, the cells are counted exactly, and
    the one with the wanted ranks is the next bracket. Then what lies below
    each bracket is counted, the nearest value on either side of it taken,
    and the values inside are ordered: at most ``bound`` per group and
    quantile, equal ones counted. Every pass is a partial aggregate, so a hot
    group is never gathered.
    """
    by, probs = list(by), list(probs)
    rows = draws.where(F.col("value").isNotNull()).select(*by, "value")
    slack = 3.0 / accuracy
    edges = lambda sign: F.percentile_approx("value", F.array(*[
        F.lit(min(1.0, max(0.0, p + sign * slack))) for p in probs]), accuracy)
    sketch = rows.groupBy(*by).agg(F.count("value").alias("_n"), edges(-1).alias("_lo"), edges(1).alias("_hi"))
    at = F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p"), F.col("_lo")[i].alias("_a"),
                                     F.col("_hi")[i].alias("_b")) for i, p in enumerate(probs)]))
    brackets = settle(sketch.select(*by, "_n", at))
    while True:
        kept = settle(_inside(rows, brackets, by).groupBy(*by, "_i", "value").count())
        wide = settle(kept.groupBy(*by, "_i").count().where(F.col("count") > bound).select(*by, "_i"))
        if wide.isEmpty():
            break
        finer = _refined(rows, brackets.join(wide, [*by, "_i"], "left_semi"), by, accuracy)
        brackets = settle(brackets.join(wide, [*by, "_i"], "left_anti").unionByName(finer))
    ends = brackets.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_a", "_b"))).alias("_e"))
    ends = ends.select(*by, F.transform("_e", lambda x: x["_a"]).alias("_lo"), F.transform("_e", lambda x: x["_b"]).alias("_hi"))
    each = lambda f: F.array(*[f(F.col("_lo")[i], F.col("_hi")[i]) for i in range(len(probs))])
    v = F.col("value")
    below = rows.join(ends, by).groupBy(*by).agg(
        each(lambda lo, hi: F.sum(F.when(v < lo, 1).otherwise(0))).alias("_below"),
        each(lambda lo, hi: F.max(F.when(v < lo, v))).alias("_pred"),
        each(lambda lo, hi: F.min(F.when(v > hi, v))).alias("_succ"))
    upto = F.sum("count").over(Window.partitionBy(*by, "_i").orderBy("value"))
    ranked = (kept.withColumn("_u", upto).join(below, by).join(brackets, [*by, "_i"])
              .select(*by, "_i", "_n", "_p", "value", F.get("_below", F.col("_i")).alias("_below"),
                      F.get("_pred", F.col("_i")).alias("_pred"), F.get("_succ", F.col("_i")).alias("_succ"), "_u"))
    rank = (F.col("_n") - 1) * F.col("_p")
    # the value at a 0-based rank is the least one with more values up to it than the rank
    value_at = lambda r: F.coalesce(F.max(F.when(r < F.col("_below"), F.col("_pred"))), F.min(
        F.when(F.col("_below") + F.col("_u") > r, F.col("value"))), F.first("_succ"))
    q = ranked.groupBy(*by, "_i").agg(value_at(F.floor(rank)).alias("_x"), value_at(F.ceil(rank)).alias("_y"),
                                      F.first(rank - F.floor(rank)).alias("_f"))
    q = q.withColumn("_q", F.col("_x") + F.col("_f") * (F.col("_y") - F.col("_x")))
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(quantile_name(p))
                                for i, p in enumerate(probs)])


def _inside(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """(by, _i, value): every row once per bracket that holds its value."""
    few = brackets.groupBy(*by).agg(F.collect_list(F.struct("_i", "_a", "_b")).alias("_e"))
    at = F.filter("_e", lambda x: (F.col("value") >= x["_a"]) & (F.col("value") <= x["_b"]))
    return rows.join(few, by).select(*by, "value", F.explode(at).alias("_x")).select(*by, F.col("_x._i").alias("_i"), "value")


def _refined(rows: DataFrame, brackets: DataFrame, by: list[str], accuracy: int) -> DataFrame:
    """The brackets cut down to the cells that hold their ranks."""
    inside = _inside(rows, brackets, by)
    cuts = F.array(*[F.lit(k / CELLS) for k in range(CELLS + 1)])
    edges = settle(inside.groupBy(*by, "_i").agg(F.array_distinct(F.percentile_approx("value", cuts, accuracy)).alias("_g")))
    # cell k holds the values from the k-th edge up to, not including, the next
    cell = F.size(F.filter("_g", lambda g: g <= F.col("value")))
    cells = inside.join(edges, [*by, "_i"]).groupBy(*by, "_i", cell.alias("_k")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("value").alias("_min"), F.max("value").alias("_max"))
    low = rows.join(brackets.groupBy(*by).agg(F.collect_list(F.struct("_i", "_a")).alias("_e")), by).select(
        *by, F.explode(F.filter("_e", lambda x: F.col("value") < x["_a"])).alias("_x"))
    low = low.groupBy(*by, F.col("_x._i").alias("_i")).agg(F.count(F.lit(1)).alias("_below"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy("_k"))
    ranked = brackets.join(cells.withColumn("_u", upto), [*by, "_i"]).join(low, [*by, "_i"], "left")
    first = F.floor((F.col("_n") - 1) * F.col("_p")) - F.coalesce("_below", F.lit(0))
    last = F.ceil((F.col("_n") - 1) * F.col("_p")) - F.coalesce("_below", F.lit(0))
    # a rank outside the bracket is the business of the nearest value beyond it
    hit = (F.col("_u") > first) & (F.col("_u") - F.col("_c") <= last)
    return ranked.groupBy(*by, "_i", "_n", "_p").agg(
        F.coalesce(F.min(F.when(hit, F.col("_min"))), F.min("_a")).alias("_a"),
        F.coalesce(F.max(F.when(hit, F.col("_max"))), F.max("_a")).alias("_b"))


# ---------------------------------------------------------------- index extraction

def parse_indices(variable_col: str = "variable") -> F.Column:
    """Integer indices inside the trailing brackets: 'x[1,4,7]' -> [1, 4, 7].

    Only the bracket is parsed, so digits in the name ('pop_0_x[1,2]') are
    never mistaken for an index.
    """
    inner = F.regexp_extract(F.col(variable_col), r"\[([0-9,]+)\]$", 1)
    return F.transform(F.split(inner, ","), lambda s: s.try_cast("int"))


def base_name(variable_col: str = "variable") -> F.Column:
    return F.regexp_extract(F.col(variable_col), r"^([^\[]+)", 1)


def apply_mapping(df: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    """Recode ``column`` through a (number, value) dimension; unmatched kept.

    Dimensions are small: AQE broadcasts them after measuring their real
    size and keeps a shuffle join when they are not.
    """
    d = dim.select(F.col("number").cast("int").alias("_num"),
                   F.col("value").cast("int").alias("_val"))
    out = df.join(d, F.col(column) == F.col("_num"), "left")
    return out.withColumn(column, F.coalesce(F.col("_val"), F.col(column))).drop("_num", "_val")


def extract_indexed(summary: DataFrame, param: str, indices: Sequence[str] | None = None,
                    mappings: Mapping[str, DataFrame] | Sequence[tuple[str, DataFrame]] | None = None,
                    keep_variable: bool = False) -> DataFrame:
    """Rows of one indexed parameter with labelled index columns.

    * several mappings (or ``indices``): variables matching ``^param[`` are
      kept and their bracket indices become columns named after the
      mappings / ``indices``, recoded through each mapping in order;
    * exactly one mapping: ``param`` is an unanchored regular expression and
      the first bracketed integer is recoded (so pass ``^name\\[`` when a
      longer name could also match);
    * neither: ``ValueError``.
    """
    if mappings is not None:
        items = list(mappings.items()) if isinstance(mappings, Mapping) else list(mappings)
        names = [n for n, _ in items]
    elif indices is not None:
        items, names = [], list(indices)
    else:
        raise ValueError("extract_indexed needs names for the index columns: pass mappings or indices")

    if mappings is not None and len(items) == 1:
        name, dim = items[0]
        out = summary.where(F.col("variable").rlike(param))
        out = out.withColumn(name, F.regexp_extract("variable", r"\[([0-9]+)", 1).try_cast("int"))
        out = apply_mapping(out, name, dim)
    else:
        out = summary.where(F.col("variable").rlike("^" + param + r"\["))
        idx = parse_indices()
        out = out.withColumns({n: F.get(idx, i) for i, n in enumerate(names)})
        for name, dim in items:
            out = apply_mapping(out, name, dim)
    if not keep_variable:
        out = out.drop("variable")
    return out


def derive_draws(draws: DataFrame, source: str, target: str, keep: Sequence[int],
                 where: F.Column | None = None, log: bool = False) -> DataFrame:
    """New draws ``target[...]`` = sum of ``source[...]`` over dropped indices.

    ``keep`` lists the 1-based index positions kept in the new name; the
    others are summed per draw. Used for totals derived from cohort arrays,
    e.g. ``pop_mig_init_total[m] = sum_a pop_mig_true[m, m, a]``.
    """
    d = draws.where(F.col("variable").startswith(source + "["))
    d = d.where(base_name() == F.lit(source)).withColumn("_idx", parse_indices())
    if where is not None:
        d = d.where(where)
    kept = [F.get(F.col("_idx"), k - 1).cast("string") for k in keep]
    name = F.concat(F.lit(target + "["), F.concat_ws(",", *kept), F.lit("]"))
    keys = [c for c in ("run_id",) if c in d.columns]
    out = (d.withColumn("variable", name)
            .groupBy(*keys, "variable", "chain", "iteration")
            .agg(F.sum("value").alias("value")))
    if log:
        out = out.withColumn("value", F.ln("value"))
    return out
