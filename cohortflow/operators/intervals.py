"""Binning by edges that are a table: each population has its own.

The edges become intervals [edge, next edge). A range condition alone would
be a nested loop over all pairs; here the finite range of a population's
edges is cut into as many coarse cells as it has intervals, an interval is
listed in the cells it touches, and a value looks only at the intervals of
its own cell: an equality join with a range check behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(edges: DataFrame, keys: Sequence[str], edge: str = "edge") -> DataFrame:
    """(keys, lo, hi, last, base, width, cells): the intervals between consecutive distinct edges.

    An edge may be -Infinity or Infinity. NULL edges are left out.
    """
    e = edges.select(*keys, F.col(edge).cast("double").alias("lo")).where(F.col("lo").isNotNull()).distinct()
    w, inf = Window.partitionBy(*keys), float("inf")
    finite = F.when(F.abs("lo") < inf, F.col("lo"))
    e = e.withColumns({"hi": F.lead("lo").over(w.orderBy("lo")), "_n": F.count(F.lit(1)).over(w) - 1,
                       "base": F.min(finite).over(w), "_top": F.max(finite).over(w)})
    e = e.where(F.col("hi").isNotNull())
    width = F.coalesce(F.try_divide(F.col("_top") - F.col("base"), F.col("_n")), F.lit(1.0))
    return e.select(*keys, "lo", "hi", (F.lead("lo").over(w.orderBy("lo"))).isNull().alias("last"),
                    F.coalesce("base", F.lit(0.0)).alias("base"),
                    F.when(width > 0, width).otherwise(F.lit(1.0)).alias("width"), F.col("_n").cast("int").alias("cells"))


def _cell(x: Column, base: str, width: str, cells: str) -> Column:
    """The coarse cell of a value; everything beyond the finite edges lies in the first or last cell."""
    at = F.floor((x - F.col(base)) / F.col(width))
    return F.when(x <= F.col(base), F.lit(0)).when(
        x >= F.col(base) + F.col(width) * F.col(cells), F.col(cells)).otherwise(at).cast("int")


def bin_by_table(df: DataFrame, edges: DataFrame, keys: Sequence[str], x: str, out: str = "bin", edge: str = "edge",
                 closed_last: bool = True) -> DataFrame:
    """``df`` with the lower edge of the interval that holds ``x`` among its key's edges; NULL outside and without edges.

    With ``closed_last`` a value equal to the last edge is in the last
    interval. Keys compare as in a join: a NULL key has no edges.
    """
    ivs = intervals(edges, keys, edge)
    grid = ivs.groupBy(*keys).agg(F.first("base").alias("_base"), F.first("width").alias("_width"), F.first("cells").alias("_cells"))
    parts = ivs.select(*keys, "lo", "hi", "last", F.explode(F.sequence(
        _cell(F.col("lo"), "base", "width", "cells"), _cell(F.col("hi"), "base", "width", "cells"))).alias("_cell"))
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("lo").alias("_lo"),
                         F.col("hi").alias("_hi"), F.col("last").alias("_last"), F.col("_cell").alias("_c2"))
    grid = grid.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_base", "_width", "_cells")
    same = lambda p: [F.col(k) == F.col(f"{p}{i}") for i, k in enumerate(keys)]
    rows = df.withColumn("_x", F.col(x).cast("double")).join(grid, same("_g"), "left")
    rows = rows.withColumn("_cell", F.when(~F.isnan("_x"), _cell(F.col("_x"), "_base", "_width", "_cells")))
    inside = (F.col("_x") >= F.col("_lo")) & ((F.col("_x") < F.col("_hi")) | (
        F.lit(closed_last) & F.col("_last") & (F.col("_x") == F.col("_hi"))))
    met = rows.join(parts, [*same("_k"), F.col("_cell") == F.col("_c2"), inside], "left")
    return met.select(*df.columns, F.col("_lo").alias(out))
