"""Positions and running sums in a global order, for groups of any size.

A window over one group sorts it in one task. Here the rows are dealt by
range on (keys, order), so a large group lies in many partitions: each
partition numbers its own part, the parts' totals give the offsets, and only
those totals (one row per partition and key) are ever ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

# Offsets are broadcast only while this many rows; beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 200_000


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: str | None = None,
             before: str = "before", total: str = "total") -> DataFrame:
    """``df`` with, per row, the weight (rows: 1 each) of its group's rows before it, and of the whole group.

    ``order`` must tell the rows of a group apart: rows equal in it get an
    arbitrary order and can't be dealt to different partitions, so count
    equal rows first and pass the count as ``weight``. NULL keys form a
    group; in the order NULLs stand where ``order`` puts them. An empty
    table stays empty.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # the borders come from a sample: they are settled before anything is derived from them
    rows = settle(rows.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    part = rows.groupBy(*keys, "_p")
    if weight is None:
        sums = part.agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_w"))
    else:
        sums = part.agg(F.lit(0).cast("long").alias("_first"), F.sum(weight).alias("_w"))
        run = Window.partitionBy(*keys, "_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_m", F.coalesce(F.sum(weight).over(run), F.lit(0)))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = settle(sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), "_first",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias("_total")))
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    on = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(sums, on).select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_before")).alias(before),
                                      F.col("_total").alias(total))
