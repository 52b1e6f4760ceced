"""Rate-table preparation: wide -> long, life table -> survival, shares.

All regions are processed together; a region filter, when given, is a
plain ``where`` that Catalyst pushes below the window, the aggregate and
the unpivot into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import leading_number, to_number

# Columns of the wide tables that carry no rates.
DEFAULT_DROP = ("Index", "Variant", "Notes", "Country code", "Type", "Parent code")


def union_sheets(sheets: Sequence[DataFrame], keys: Sequence[str] | None = None) -> DataFrame:
    """Stack sheets of one workbook (UNION ALL by name) with a ``sheet`` number.

    With ``keys`` the stack is de-duplicated on them, keeping the row of the
    first sheet that has the key (estimates win over projections).
    """
    out = None
    for i, sheet in enumerate(sheets, start=1):
        s = sheet.withColumn("sheet", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    if keys:
        rest = [c for c in out.columns if c not in keys and c != "sheet"]
        first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.col("sheet"))
        out = (out.groupBy(*keys).agg(first.alias("_r"), F.min("sheet").alias("sheet"))
                  .select(*keys, "_r.*", "sheet"))
    return out


def tidy_rates(wide: DataFrame, value_name: str, ids: Sequence[str] = ("region", "period"),
               drop: Sequence[str] = DEFAULT_DROP, age_stops: str = "-+",
               period_is_range: bool = False, scale: float | None = None,
               max_year: int | None = None) -> DataFrame:
    """Wide rate table -> (region, year, age, value).

    Every non-id column is an age band ("15-19", "100+"); its label becomes
    the band's lower age. Values are text and become doubles, bad text NULL.
    ``period_is_range`` reads "1950-1955" as 1950, otherwise the period is a
    single year. ``scale`` divides the values (1000 for per-mille rates).
    """
    wide = wide.drop(*[c for c in drop if c in wide.columns])
    values = [c for c in wide.columns if c not in ids]
    long = wide.select(*ids, *[F.col(c).cast("string").alias(c) for c in values]).unpivot(
        list(ids), values, "band", "_text")
    year = leading_number("period", "-") if period_is_range else to_number("period")
    val = to_number("_text")
    if scale:
        val = val / F.lit(float(scale))
    out = long.select(
        *[c for c in ids if c != "period"],
        year.cast("int").alias("year"),
        leading_number("band", age_stops).cast("int").alias("age"),
        val.alias(value_name),
    )
    if max_year is not None:
        out = out.where(F.col("year") <= max_year)
    return out


def tidy_life_table(life: DataFrame, region: str = "region", period: str = "period",
                    age: str = "age", lx: str = "Lx") -> DataFrame:
    """Project-and-replace: keep four columns, person-years as double."""
    return life.select(
        F.col(region).alias("region"),
        F.col(age).cast("int").alias("age"),
        F.col(period).alias("period"),
        to_number(lx).alias("Lx"),
    )


def survival_ratios(life: DataFrame, max_year: int | None = None,
                    keep_last: bool = False) -> DataFrame:
    """Abridged life table -> survival ratio L(x+n)/L(x) per (region, year, age).

    Age 1 is merged into age 0 by summing person-years (NULL if any part is
    NULL, as R's ``sum``). The ratio uses the next age of the same region and
    year; the open top age has none and is dropped unless ``keep_last``.
    Division by zero gives NULL.
    """
    t = tidy_life_table(life) if "Lx" in life.columns and life.schema["Lx"].dataType.typeName() == "string" else life
    t = t.select(
        "region",
        leading_number("period", "-").cast("int").alias("year"),
        F.when(F.col("age") == 1, F.lit(0)).otherwise(F.col("age")).alias("age"),
        "Lx",
    )
    g = t.groupBy("region", "year", "age").agg(
        F.when(F.count("Lx") == F.count(F.lit(1)), F.sum("Lx")).alias("Lx"))
    w = Window.partitionBy("region", "year").orderBy("age")
    out = g.withColumn("surv", F.try_divide(F.lead("Lx").over(w), F.col("Lx")))
    if max_year is not None:
        out = out.where(F.col("year") <= max_year)
    if not keep_last:
        out = out.where(F.col("surv").isNotNull())
    return out


def shift_survival(ratios: DataFrame, at_birth: float = 1.0, keys: Sequence[str] = ("region", "year")) -> DataFrame:
    """Survival moved one age group up: the ratio L(x+5)/L(x) stands at x + 5, the age it leads to.

    The models read the entry of the age reached, and the first one as the
    survival at birth; ``at_birth`` fills that one. Optional: the default is
    the unshifted data. The top age's own ratio has no age to lead to and
    goes; a group is one population's period, bounded by the ages.
    """
    before = F.lag("surv").over(Window.partitionBy(*keys).orderBy("age"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("age")) == 1
    return ratios.withColumn("surv", F.when(first, F.lit(float(at_birth))).otherwise(before))


def align_fertility(fert: DataFrame, surv: DataFrame,
                    keys: Sequence[str] = ("region", "year", "age")) -> DataFrame:
    """Fertility on every survival cell: right join on the keys, NULL -> 0."""
    cells = surv.select(*keys)
    out = cells.join(fert.select(*keys, "fert"), list(keys), "left")
    return out.withColumn("fert", F.coalesce(F.col("fert"), F.lit(0.0)))


def age_shares(pop: DataFrame, keys: Sequence[str] = ("region", "year"),
               value: str = "pop", na_rm: bool = False) -> DataFrame:
    """Share of each age in its (region, period) total, before any age filter.

    Without ``na_rm`` a NULL anywhere in the group makes the total NULL (R's
    ``sum``), so every share of that period is NULL.
    """
    w = Window.partitionBy(*keys)
    total = F.sum(value).over(w)
    if not na_rm:
        total = F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), total)
    return pop.withColumn("pop_prop", F.col(value) / total)


def restrict_to_domain(df: DataFrame, **domains: DataFrame) -> DataFrame:
    """Keep rows whose columns are members of the given one-column domains.

    ``restrict_to_domain(shares, year=year_dim_values, age=age_values)`` is a
    left-semi join per column. Domains are small; AQE turns the join into a
    broadcast once the domain's real size is known, and keeps a shuffle
    join beyond the threshold.
    """
    for col, dom in domains.items():
        d = dom.select(F.col(dom.columns[0]).alias(col)).distinct()
        df = df.join(d, [col], "left_semi")
    return df


def initial_age_profile(pop: DataFrame, keys: Sequence[str] = ("region",),
                        value: str = "pop_prop") -> DataFrame:
    """Age profile of the first period, top age dropped, as an ordered array.

    ``period == min(period)`` and ``age != max(age)`` are evaluated per key
    with window aggregates (no global sort, no driver round trip); the
    vector is ordered by age, not by row order.
    """
    w = Window.partitionBy(*keys)
    first = (pop.withColumn("_y0", F.min("year").over(w))
                .withColumn("_amax", F.max("age").over(w))
                .where((F.col("year") == F.col("_y0")) & (F.col("age") != F.col("_amax"))))
    prof = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("age", value))).alias("_p"))
    return prof.select(*keys, F.col("_p.age").alias("ages"),
                       F.col("_p." + value).alias("profile"))
