"""Dimensions (1-based index -> value), bin edges, keyed dense arrays.

Dimensions are tiny (one row per age group or period), so numbering them
with a global window is bounded work; the large tables never go through a
single partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def dim_from_values(values: DataFrame, column: str, extra_step: int | None = None) -> DataFrame:
    """(number, value) with 1-based dense numbering of the distinct values.

    ``extra_step`` appends max + step (the age dimension has K + 1 entries
    because survival and fertility carry one more age than the population).
    The distinct values are gathered by a partial + final aggregate (bounded
    by the domain) and numbered by position; no unpartitioned window.
    """
    vals = F.array_sort(F.collect_set(F.col(column).cast("int")))
    arr = values.agg(vals.alias("v"))
    if extra_step is not None:
        arr = arr.select(F.when(F.size("v") > 0, F.concat("v", F.array(F.array_max("v") + F.lit(extra_step))))
                         .otherwise(F.col("v")).alias("v"))
    out = arr.select(F.posexplode_outer("v").alias("number", "value")).where(F.col("value").isNotNull())
    return out.select((F.col("number") + 1).alias("number"), "value")


def age_dim(rates: DataFrame, step: int = 5) -> DataFrame:
    return dim_from_values(rates, "age", extra_step=step)


def year_dim(rates: DataFrame) -> DataFrame:
    return dim_from_values(rates, "year")


def edges_of(dim: DataFrame, step: int | None = 5, open_top: bool = False) -> DataFrame:
    """One-row frame with ``edges``: sorted values, plus max+step or +Inf."""
    vals = F.array_sort(F.collect_list(F.col("value").cast("double")))
    row = dim.agg(vals.alias("edges"))
    if open_top:
        return row.select(F.concat("edges", F.array(F.lit(float("inf")))).alias("edges"))
    if step is not None:
        return row.select(F.concat("edges", F.array(F.element_at("edges", -1) + F.lit(float(step)))).alias("edges"))
    return row


def period_edges(year_dim_df: DataFrame, step: int = 5) -> DataFrame:
    """Bin edges of the periods: every start year plus the last end year."""
    return edges_of(year_dim_df, step=step)


def domain_values(dom: DataFrame) -> F.Column:
    """Scalar subquery: sorted distinct values of a one-column domain."""
    return dom.agg(F.array_sort(F.collect_set(F.col(dom.columns[0]).cast("int")))).scalar()


def complete_grid(counts: DataFrame, dims: dict[str, DataFrame], value: str = "n",
                  fill: float = 0.0, by: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """Complete a key grid and fill missing cells (tidyr ``complete``).

    ``dims`` maps each key column to a one-column domain (or an array
    Column, e.g. a field of a scalar-subquery struct). The grid is made
    by exploding each domain (a scalar subquery over a small dimension) per
    group, so no cross join is planned; it is then left-joined to the
    counts. Rows whose key lies outside the domains are not kept.
    """
    spark = counts.sparkSession
    if by:
        grid = (groups if groups is not None else counts).select(*by).distinct()
    else:
        grid = spark.range(1).select()
    for col, dom in dims.items():
        values = dom if isinstance(dom, F.Column) else domain_values(dom)
        grid = grid.withColumn(col, F.explode(values))
    keys = list(by) + list(dims)
    out = grid.join(counts.select(*keys, value), keys, "left")
    return out.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(float(fill))))


def to_matrix(df: DataFrame, row: str, col: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Keyed long -> dense row-major matrix: one array per row key.

    Cells are ordered by the key values (never by row order); a missing
    cell must be completed first (see :func:`complete_grid`).
    Output: by..., ``matrix`` array<array<double>> ordered by ``row``.
    """
    rows = df.groupBy(*by, row).agg(
        F.array_sort(F.collect_list(F.struct(F.col(col).alias("k"), F.col(value).cast("double").alias("v")))).alias("_c"))
    rows = rows.select(*by, row, F.col("_c.v").alias("cells"))
    mat = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("k"), F.col("cells").alias("v")))).alias("_r"))
    return mat.select(*by, F.col("_r.k").alias(row + "s"), F.col("_r.v").alias("matrix"))


def fertile_window(fert: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First/last fertile age position, ages before/after, number fertile.

    An age is fertile when any period has a rate above 0. Positions are
    1-based over the ordered ages of the group (an array per group, bounded
    by the number of age groups).
    """
    flags = fert.groupBy(*by, "age").agg(F.bool_or(F.col("fert") > 0).alias("fertile"))
    g = flags.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("age", "fertile"))).alias("_a"))
    pos = F.transform("_a", lambda x, i: F.when(x["fertile"], i + 1))
    fertile_ages = F.transform(F.filter("_a", lambda x: x["fertile"]), lambda x: x["age"])
    g = g.select(*by, "_a", F.array_min(pos).alias("_first"), F.array_max(pos).alias("_last"),
                 fertile_ages.alias("_fa"))
    return g.select(
        *by,
        F.size("_a").cast("long").alias("n_ages"),
        F.size("_fa").cast("long").alias("n_fert_ages"),
        F.array_min("_fa").alias("first_fertile_age"),
        F.array_max("_fa").alias("last_fertile_age"),
        (F.col("_first") - 1).alias("ages_before_fert"),
        (F.size("_a") - F.col("_last")).cast("long").alias("ages_after_fert"),
    )


def _at_key(cells, year, age, field: str) -> F.Column:
    """Value of a cell by its key; a missing one is carried forward.

    ``cells`` is sorted by year. The last known value of the age up to the
    year stands in for a missing cell, or the first known one if there is
    none before; an age without any value gives NULL.
    """
    known = F.filter(cells, lambda x: (x["age"] == age) & x[field].isNotNull())
    upto = F.filter(known, lambda x: x["year"] <= year)
    return F.coalesce(F.try_element_at(upto, F.lit(-1))[field], F.try_element_at(known, F.lit(1))[field])


def keyed_matrix(cells: DataFrame, value: str, by: Sequence[str] = ("region",)) -> DataFrame:
    """(by..., years, ages, matrix): dense [year][age] values, each at its key's place.

    The grid is the group's own years times its own ages; missing cells are
    carried forward (see :func:`missing_cells` for their list).
    """
    g = cells.groupBy(*by).agg(F.array_sort(F.collect_list(
        F.struct("year", "age", F.col(value).cast("double").alias("v")))).alias("_cells"))
    g = g.select(*by, "_cells", F.array_sort(F.array_distinct(F.transform("_cells", lambda x: x["year"]))).alias("years"),
                 F.array_sort(F.array_distinct(F.transform("_cells", lambda x: x["age"]))).alias("ages"))
    return g.select(*by, "years", "ages", F.transform("years", lambda y: F.transform(
        "ages", lambda a: _at_key(F.col("_cells"), y, a, "v"))).alias("matrix"))


def missing_cells(cells: DataFrame, value: str, by: Sequence[str] = ("region",)) -> DataFrame:
    """(by..., year, age) of the group's grid that have no row or a NULL value."""
    g = cells.groupBy(*by).agg(F.collect_set("year").alias("_y"), F.collect_set("age").alias("_a"))
    grid = g.select(*by, "_a", F.explode("_y").alias("year")).select(*by, "year", F.explode("_a").alias("age"))
    have = cells.where(F.col(value).isNotNull()).select(*by, "year", "age")
    return grid.join(have, [*by, "year", "age"], "left_anti")


def model_input(surv: DataFrame, fert: DataFrame, by: Sequence[str] = ("region",),
                prop_f: float = 1 / (1 + 1.05)) -> DataFrame:
    """One record per population with everything the projection needs.

    K (age groups), Time (periods), prop_f, surv_mean [Time][K],
    fert_mean [Time][n_fert] (fertile ages only), n_fert_ages, ages before
    and after the fertile window, plus the ordered ``ages``, ``years`` and
    ``fertile_ages``.

    The population's cells (periods x ages, bounded by the model's domain,
    not by data volume) are gathered by one ``groupBy`` and every field is
    derived from that sorted cell list with array functions, so the record
    costs one exchange instead of one per field. Every matrix cell is looked
    up by its (year, age) key on the population's complete grid; a missing
    survival cell is carried forward (:func:`missing_cells` lists them), a
    missing fertility cell is 0.
    """
    by = list(by)
    keys = [F.col(k) for k in by]
    cells = surv.select(*by, "year", "age", "surv").join(
        fert.select(*by, "year", "age", F.col("fert").alias("_f")), [*by, "year", "age"], "left")
    g = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("year", "age", F.col("surv").cast("double").alias("surv"),
                 F.col("_f").cast("double").alias("fert")))).alias("_cells"))
    c = F.col("_cells")
    ages = F.array_sort(F.array_distinct(F.transform(c, lambda x: x["age"])))
    years = F.array_sort(F.array_distinct(F.transform(c, lambda x: x["year"])))
    g = g.select(*by, "_cells", ages.alias("ages"), years.alias("years"))
    fertile = F.filter("ages", lambda a: F.exists("_cells", lambda x: (x["age"] == a) & (x["fert"] > 0)))
    g = g.withColumn("_fertile", fertile)
    pos = F.transform("ages", lambda a, i: F.when(F.array_contains("_fertile", a), i + 1))
    first = F.array_min(pos)
    last = F.array_max(pos)
    surv_mean = F.transform("years", lambda y: F.transform(
        "ages", lambda a: _at_key(F.col("_cells"), y, a, "surv")))
    fert_mean = F.transform("years", lambda y: F.transform("_fertile", lambda a: F.coalesce(
        F.try_element_at(F.filter("_cells", lambda x: (x["year"] == y) & (x["age"] == a)), F.lit(1))["fert"],
        F.lit(0.0))))
    return g.select(
        *by,
        F.size("ages").alias("K"),
        F.size("years").alias("Time"),
        F.lit(float(prop_f)).alias("prop_f"),
        "ages", "years", F.col("_fertile").alias("fertile_ages"),
        surv_mean.alias("surv_mean"),
        fert_mean.alias("fert_mean"),
        F.size("_fertile").alias("n_fert_ages"),
        (first - 1).alias("ages_before_fert"),
        (F.size("ages") - last).alias("ages_after_fert"),
    )


def with_observations(record: DataFrame, fields: dict[str, F.Column], t_obs: Sequence[int]) -> DataFrame:
    """Model input record with its observations and hyper-parameters.

    ``fields`` maps a name to one observation (a vector or a matrix), to be
    repeated along the observation dimension [n_obs]..., or to a constant
    column, kept as it is. Without any observation ``t_obs`` is [0] and
    ``n_obs`` 1, as the models expect.
    """
    periods = list(t_obs) or [0]
    out = record.withColumn("t_obs", F.array(*[F.lit(int(t)) for t in periods])).withColumn("n_obs", F.lit(len(periods)))
    for name, col in fields.items():
        out = out.withColumn(name, F.array_repeat(col, len(periods)) if name.endswith("_obs") else col)
    return out
