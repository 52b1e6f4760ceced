"""Survey microdata -> complete count grids on the model's age/period axes.

Counts are aggregated before any row expansion (a count per band is spread
over single years only after the ``groupBy``), so the explode multiplies
grouped rows, never raw survey rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bin_lower_edge, once, to_number
from .dims import complete_grid


def edges_column(edges_frame: DataFrame) -> Column:
    """Scalar subquery over a one-row ``edges`` frame (see ``dims.edges_of``)."""
    return edges_frame.select("edges").scalar()


def axes_from_rates(rates: DataFrame, step: int = 5) -> DataFrame:
    """One row with every axis the survey counts need: sorted ``years`` and
    ``ages`` (the rate table's periods and age groups), ``period_edges``
    (years plus the last end year) and ``age_edges`` (ages plus +Inf).

    Used through :func:`axes_column` as a single scalar subquery, so the
    binning and the grid completion share one small computation.
    """
    a = rates.agg(F.array_sort(F.collect_set(F.col("year").cast("int"))).alias("years"),
                  F.array_sort(F.collect_set(F.col("age").cast("int"))).alias("ages"))
    dbl = lambda c: F.transform(c, lambda v: v.cast("double"))
    return a.select(
        "years", "ages",
        F.concat(dbl("years"), F.array(F.element_at("years", -1).cast("double") + F.lit(float(step))))
         .alias("period_edges"),
        F.concat(dbl("ages"), F.array(F.lit(float("inf")))).alias("age_edges"))


def axes_column(axes: DataFrame) -> Column:
    """The axes row as one struct-valued scalar subquery."""
    return axes.select(F.struct(*axes.columns).alias("ax")).scalar()


def stepped_edges(ages: DataFrame, step: int = 5, top_offset: int = 0, column: str = "age") -> DataFrame:
    """seq(0, max(age) - top_offset, step) then +Inf (household-age bins)."""
    hi = F.max(F.col(column)).cast("int") - F.lit(top_offset)
    seq = F.transform(F.sequence(F.lit(0), hi, F.lit(step)), lambda v: v.cast("double"))
    return ages.agg(F.concat(seq, F.array(F.lit(float("inf")))).alias("edges"))


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """``count(keys)``: rows per key combination (partial + final hash agg)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# Fixed value: the column set of one survey; another survey passes its own names.
PERSON_COLUMNS = {"gender": "basic_gender", "age": "basic_age", "year": "year_migration_m",
                  "age_at_move": "age_migration_m", "native": "born_kenya_m"}


def _binned(counts: DataFrame, bins: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Counts of raw values -> counts of bins; a value outside the edges has a NULL bin.

    The bins come out of a generator: a filter on them stays above the
    counts instead of binning every person at the scan.
    """
    binned = counts.select(*by, "n", F.inline(F.array(F.struct(*[c.alias(k) for k, c in bins.items()]))))
    return binned.groupBy(*by, *bins).agg(F.sum("n").alias("n"))


def _women(persons: DataFrame, gender: int | None, cols: dict) -> DataFrame:
    return persons if gender is None else persons.where(F.col(cols["gender"]) == gender)


def cohort_bins(persons: DataFrame, axes: DataFrame, gender: int | None = 2, by: Sequence[str] = (),
                columns: dict | None = None) -> DataFrame:
    """Migrants by (arrival period, age group); persons outside the edges are in NULL bins.

    Persons are counted by their raw year and age first (partial aggregates),
    so only distinct values are binned.
    """
    c = columns or PERSON_COLUMNS
    p = _women(persons, gender, c).where(F.col(c["year"]).isNotNull() & F.col(c["age_at_move"]).isNotNull())
    raw = count_by(p.select(*by, F.col(c["year"]).alias("_y"), F.col(c["age"]).alias("_a")), [*by, "_y", "_a"])
    raw = raw.withColumn("_ax", axes_column(axes))
    return _binned(raw, {"mig_year": bin_lower_edge("_y", F.col("_ax.period_edges")).cast("int"),
                         "age": bin_lower_edge("_a", F.col("_ax.age_edges")).cast("int")}, by)


def native_bins(persons: DataFrame, axes: DataFrame, gender: int | None = 2, by: Sequence[str] = (),
                columns: dict | None = None) -> DataFrame:
    """Native-born persons by age group; persons outside the edges are in a NULL bin."""
    c = columns or PERSON_COLUMNS
    p = _women(persons, gender, c).where(F.col(c["native"]) == 1)
    raw = count_by(p.select(*by, F.col(c["age"]).alias("_a")), [*by, "_a"]).withColumn("_ax", axes_column(axes))
    return _binned(raw, {"age": bin_lower_edge("_a", F.col("_ax.age_edges")).cast("int")}, by)


def count_cohort_age(persons: DataFrame, axes: DataFrame, gender: int | None = 2,
                     by: Sequence[str] = (), groups: DataFrame | None = None, columns: dict | None = None) -> DataFrame:
    """Migrants by (arrival period, age group) on the complete grid, 0-filled.

    Persons with a missing migration year or age are left out; those outside
    the edges are reported by :func:`dropped_counts`. With ``by`` every group
    among all ``persons`` (or ``groups``) gets its grid, counted or not.
    """
    ax = axes_column(axes)
    counts = cohort_bins(persons, axes, gender, by, columns).dropna(subset=["mig_year", "age"])
    return complete_grid(counts, {"mig_year": ax.getField("years"), "age": ax.getField("ages")}, by=by,
                         groups=(persons if groups is None else groups) if by else None)


def count_native_age(persons: DataFrame, axes: DataFrame, gender: int | None = 2,
                     by: Sequence[str] = (), groups: DataFrame | None = None, columns: dict | None = None) -> DataFrame:
    """Native-born persons by age group on the complete age axis, 0-filled."""
    ax = axes_column(axes)
    counts = native_bins(persons, axes, gender, by, columns).dropna(subset=["age"])
    return complete_grid(counts, {"age": ax.getField("ages")}, by=by,
                         groups=(persons if groups is None else groups) if by else None)


def dropped_counts(persons: DataFrame, axes: DataFrame, gender: int | None = 2,
                   columns: dict | None = None) -> DataFrame:
    """(table, reason, n): persons that the count grids leave out because a value lies outside the edges."""
    m = cohort_bins(persons, axes, gender, (), columns)
    m = m.select(F.lit("cohort_age").alias("table"), F.when(F.col("mig_year").isNull() & F.col("age").isNull(), "both")
                 .when(F.col("mig_year").isNull(), "year").when(F.col("age").isNull(), "age").alias("reason"), "n")
    n = native_bins(persons, axes, gender, (), columns).select(
        F.lit("native_age").alias("table"), F.when(F.col("age").isNull(), "age").alias("reason"), "n")
    return m.union(n).where(F.col("reason").isNotNull()).groupBy("table", "reason").agg(F.sum("n").alias("n"))


def count_full_outer(members: DataFrame, edges: DataFrame, domain: DataFrame,
                     gender: int = 2) -> DataFrame:
    """Household members per age group, full outer join with the age domain.

    Groups missing from the survey get 0; members outside every bin form a
    NULL-age group that the full join keeps (as the reference does). Members
    are counted by their raw age first, so only distinct ages are binned.
    """
    raw = count_by(members.where((F.col("gender") == gender) & F.col("age").isNotNull()).select("age"), ["age"])
    # edges as a column first: Spark allows no subquery inside the lambda
    raw = raw.withColumn("_ae", edges_column(edges))
    counts = _binned(raw, {"age": bin_lower_edge(to_number("age"), "_ae").cast("int")})
    dom = domain.select(F.col(domain.columns[0]).cast("int").alias("age")).distinct()
    out = counts.join(dom, ["age"], "full")
    return out.withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))


def exclude_listed(df: DataFrame, listed: DataFrame, key: str, list_key: str | None = None) -> DataFrame:
    """Anti join with a list; rows with a NULL key are kept (unlike NOT IN)."""
    lk = list_key or listed.columns[0]
    lst = listed.select(F.col(lk).alias("_listed")).distinct()
    return df.join(lst, df[key] == lst["_listed"], "left_anti")


def band_limits(band: str | Column) -> tuple[Column, Column]:
    """'Below 15' -> (0, 15); '15-25' -> (15, 25); '60+' -> (60, NULL)."""
    text = F.regexp_replace(band if isinstance(band, Column) else F.col(band), "Below 15", "0-15")
    parts = F.split(text, "[^A-Za-z0-9]+")
    return F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")


def spread_bands(counts: DataFrame, band: str, n: str = "n", keep: Sequence[str] = (),
                 inclusive_end: bool = False) -> DataFrame:
    """Spread each band's count evenly over its single years [lo, hi), or [lo, hi] with ``inclusive_end``.

    A band without an upper limit (or with hi <= lo) cannot be spread and
    yields no rows; ``unspread_bands`` reports those.
    """
    lo, hi = band_limits(band)
    if inclusive_end:
        hi = hi + 1
    c = counts.select(*keep, n, lo.alias("_lo"), hi.alias("_hi"))
    ok = F.col("_hi") > F.col("_lo")
    years = F.when(ok, F.sequence(F.col("_lo"), F.col("_hi") - 1))
    return c.select(*keep, F.explode(years).alias("age"),
                    (F.col(n) / (F.col("_hi") - F.col("_lo"))).alias(n))


def unspread_bands(counts: DataFrame, band: str, n: str = "n") -> DataFrame:
    """(band, n): counts of the bands that :func:`spread_bands` cannot spread."""
    lo, hi = band_limits(band)
    return counts.where(~F.coalesce(hi > lo, F.lit(False))).select(band, n)


def banded_migrants(survey: DataFrame, axes: DataFrame, inclusive_end: bool = False) -> DataFrame:
    """Banded survey -> migrants by (arrival period, age group), 0-filled grid.

    Literal filter semantics: ``mig IS NOT NULL OR mig <> 'Non applicable'``
    (NULL drops), numeric year after ``try_cast``, strictly after the first
    period edge.
    """
    ax = axes_column(axes)
    m = survey.where(F.col("mig").isNotNull() | (F.col("mig") != "Non applicable"))
    m = m.withColumn("mig_year", to_number("mig")).where(F.col("mig_year") > F.element_at(ax.getField("period_edges"), 1))
    counts = count_by(m, ["age_member", "mig_year"])
    spread = spread_bands(counts, "age_member", keep=["mig_year"], inclusive_end=inclusive_end).withColumn("_ax", ax)
    binned = once(spread.select("n", "_ax", F.col("mig_year").alias("_y"), F.col("age").alias("_a")),
                  mig_year=bin_lower_edge("_y", F.col("_ax.period_edges")).cast("int"),
                  age=bin_lower_edge("_a", F.col("_ax.age_edges")).cast("int"))
    sums = binned.where(F.col("mig_year").isNotNull() & F.col("age").isNotNull()) \
                 .groupBy("mig_year", "age").agg(F.sum("n").alias("n"))
    return complete_grid(sums, {"mig_year": ax.getField("years"), "age": ax.getField("ages")})


def banded_natives(survey: DataFrame, axes: DataFrame, birth_places: Sequence[str],
                   native_only_non_applicable: bool = False, inclusive_end: bool = False) -> DataFrame:
    """Banded survey -> native-born by age group, 0-filled.

    ``mig IS NOT NULL OR mig = 'Non applicable'`` keeps every non-null
    ``mig`` (real years too), as the reference does;
    ``native_only_non_applicable`` keeps only those who never moved.
    """
    ax = axes_column(axes)
    stayed = F.col("mig") == "Non applicable"
    s = survey.where(F.col("cbirth").isin(list(birth_places))
                     & (stayed if native_only_non_applicable else F.col("mig").isNotNull() | stayed))
    counts = count_by(s, ["age_member"])
    spread = spread_bands(counts, "age_member", inclusive_end=inclusive_end).withColumn("_ax", ax)
    binned = spread.select(bin_lower_edge("age", F.col("_ax.age_edges")).cast("int").alias("age"), "n")
    sums = binned.where(F.col("age").isNotNull()).groupBy("age").agg(F.sum("n").alias("n"))
    return complete_grid(sums, {"age": ax.getField("ages")})
