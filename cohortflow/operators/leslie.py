"""Leslie matrices as triplets: sparse products as keyed joins and sums.

A matrix is rows (keys..., row, col, value) with only its structural
entries: K of the first row, K - 1 below the diagonal, one for the open
group. A product joins the inner index and sums, so a matrix is never an
array, its size doesn't matter, and every key (population, draw, ...) is
spread by the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import balance, settle
from .cohort import leslie_entries


def triplets(rows: DataFrame, keys: Sequence[str], surv: str = "surv", reprod: str = "reprod",
             births: bool = True) -> DataFrame:
    """(keys, t, row, col, value): every period's matrix; ``births=False`` gives those of migrant cohorts.

    A row without rates (NULL arrays) gives no entries.
    """
    per = rows.select(*keys, F.posexplode_outer(F.arrays_zip(F.col(surv).alias("s"), F.col(reprod).alias("r"))).alias("_t", "_z"))
    ent = per.where(F.col("_t").isNotNull()).select(
        *keys, (F.col("_t") + 1).alias("t"), F.explode_outer(leslie_entries(F.col("_z.s"), F.col("_z.r"), births)).alias("e"))
    return ent.select(*keys, "t", "e.row", "e.col", "e.value")


def times_vector(matrix: DataFrame, vector: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, value): matrix (keys, row, col, value) times vector (keys, a, value).

    Rows of the matrix without an entry that meets the vector are absent
    (0); a NULL entry or cell makes its sum NULL.
    """
    v = vector.select(*keys, F.col("a").alias("col"), F.col("value").alias("_x"))
    return _summed(matrix.join(v, [*keys, "col"]), [*keys, F.col("row").alias("a")], F.col("value") * F.col("_x"))


def times_matrix(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row, col, value): the product of two triplet matrices."""
    r = right.select(*keys, F.col("row").alias("_k"), F.col("col").alias("_c"), F.col("value").alias("_x"))
    met = left.withColumnRenamed("col", "_k").join(r, [*keys, "_k"])
    return _summed(met, [*keys, "row", F.col("_c").alias("col")], F.col("value") * F.col("_x"))


def _summed(df: DataFrame, by: list, term) -> DataFrame:
    whole = F.count(term) == F.count(F.lit(1))
    return df.groupBy(*by).agg(F.when(whole, F.sum(term)).alias("value"))


def product(matrices: DataFrame, keys: Sequence[str], periods: int) -> DataFrame:
    """(keys, t0, row, col, value): the ``periods``-period matrix from each block of consecutive periods.

    Block ``t0`` holds periods t0 + 1 .. t0 + periods (a last, shorter block
    too); later periods multiply from the left. Neighbours are multiplied
    pairwise, so the number of steps is the logarithm of the block's length.
    The entries are dealt by block once. In a step a column of the later
    matrix meets the row of the earlier one that has its inner index, and
    the products are summed where they are: nothing moves again.
    """
    group, left = [*keys, "t0"], periods
    at = matrices.select(*keys, (F.floor((F.col("t") - 1) / periods) * periods).cast("int").alias("t0"),
                         ((F.col("t") - 1) % periods).alias("j"), "row", "col", "value")
    if left > 1:
        at = balance(at, *group)
    while left > 1:
        at = at.withColumns({"odd": F.col("j") % 2, "j": F.floor(F.col("j") / 2).cast("int")})
        # in a block of odd length the last one has no neighbour, and its entries stay as they are
        at = at.withColumn("paired", F.max("odd").over(Window.partitionBy(*group, "j")) == 1)
        odd = F.col("odd") == 1
        met = at.groupBy(*group, "j", "paired", F.when(odd, F.col("col")).otherwise(F.col("row")).alias("_k")).agg(
            F.collect_list(F.when(odd, F.struct("row", "value"))).alias("_l"),
            F.collect_list(F.when(~odd, F.struct("col", "value"))).alias("_r"))
        alone = F.array(F.struct(F.col("_k").alias("row"), F.lit(1.0).alias("value")))
        met = met.select(*group, "j", "paired", F.posexplode("_r").alias("_n", "_e"),
                         F.when(F.col("paired"), F.col("_l")).otherwise(alone).alias("_l"))
        met = met.select(*group, "j", "paired", F.when(~F.col("paired"), F.col("_n")).alias("_n"), "_e", F.explode("_l").alias("_o"))
        term = F.when(F.col("paired"), F.col("_o.value") * F.col("_e.value")).otherwise(F.col("_e.value"))
        by = [*group, "j", "paired", "_n", F.col("_o.row").alias("row"), F.col("_e.col").alias("col")]
        at = _summed(met, by, term).select(*group, "j", "row", "col", "value")
        left = (left + 1) // 2
    return at.drop("j")


def project(matrices: DataFrame, start: DataFrame, keys: Sequence[str], periods: int, rate_offset: int = 1) -> DataFrame:
    """(keys, t, a, value): the population of every period from sparse products.

    ``start`` (keys, a, value) is the population of period 1; period t uses
    the matrix of period ``t - rate_offset``. The matrices are dealt by key
    once; a period is one keyed join and sum, settled every few periods.
    """
    dealt = settle(matrices.repartition(*keys))
    now = start.select(*keys, "a", "value")
    out = [now.withColumn("t", F.lit(1))]
    for t in range(2, periods + 1):
        now = times_vector(dealt.where(F.col("t") == t - rate_offset).drop("t"), now, keys)
        if t % 4 == 0:
            now = settle(now)
        out.append(now.withColumn("t", F.lit(t)))
    both = out[0]
    for part in out[1:]:
        both = both.unionByName(part)
    return both
