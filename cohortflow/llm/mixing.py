"""Mixing sources to target weights by entropy balancing.

Every document starts at a rate of one copy. The rates closest to that in
relative entropy that meet each source's token target have the form
``min(cap, exp(lambda * size))``; ``lambda`` solves the convex dual, found by
safeguarded Newton steps whose gradient and Hessian are aggregates over
(source, size) cells. Rates become copies by a threshold on a hash of the id;
the threshold of each source is then shifted, and a few single documents
moved, until the words taken are as near the target as whole documents allow.

What a source needs (lambda, shift, moved documents) is one row per source.
It is broadcast only while the number of sources is at most
``BROADCAST_SOURCES``; otherwise it is joined, and a hot source can be split.

Defined results: a null text has size 0; the null source is a source, last
in order; documents of size 0 take 0 words; rows equal in id, source and size
get equal copies; without any word all targets are 0; an empty table gives an
empty mix. Reruns give the same copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_WORD, packed, settled

WEIGHTS = (5, 2, 1)
BUDGET, CAP = 1.5, 2
BROADCAST_SOURCES = 20_000
NEWTON_ROUNDS, TOLERANCE = 60, 1e-7
BUCKETS, MOVES = 1024, 4


def _beside(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Each row with its source's columns (null-safe)."""
    small = sources.withColumnRenamed("source", "_source")
    small = F.broadcast(small) if n_sources <= BROADCAST_SOURCES else small
    return rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of each source by code point with null last, without gathering them in one task."""
    order = [F.isnull("source"), F.col("source")]
    parts = settled(sources.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").count()
    offsets = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_i", local).join(offsets, "_p").withColumn("pos", F.col("_i") + F.col("_o")).drop(
        "_p", "_i", "_o")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
            cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, filled up to ``cap`` times the size."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    df = settled(ranked(sources).withColumn("w", F.get(cycle, (F.col("pos") % len(weights)).cast("int"))))
    total, weight = df.agg(F.sum("source_size"), F.sum("w")).first()
    total = (total or 0) * budget
    level = total / weight if weight else 0.0
    while True:  # each round closes at least one more source, a few rounds in practice
        full = F.col("w") * level > cap * F.col("source_size")
        closed, left = df.agg(F.sum(F.when(full, cap * F.col("source_size"))), F.sum(F.when(~full, F.col("w")))).first()
        new = (total - float(closed or 0)) / left if left else level
        if not left or new <= level:
            break
        level = new
    return df.select("source", "source_size", F.least(F.col("w") * level, cap * F.col("source_size").cast("double"))
                     .alias("target"))


def rate(lam: str | Column, size: str | Column, scale: str | Column, cap: float = CAP) -> Column:
    """Exponentially tilted rate, at most ``cap``; a null lambda stands for the cap itself."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    tilt = F.least(col(lam) * col(size) / col(scale), F.lit(math.log(cap)))
    return F.round(F.coalesce(F.exp(tilt), F.lit(float(cap))), 9)


def dual(cells: DataFrame, sources: DataFrame, n_sources: int, cap: float = CAP) -> DataFrame:
    """(source, lam, scale): the dual solution of each source.

    ``cells`` has (source, size, n). A round is one aggregate over the cells;
    a Newton step that leaves the bracket is replaced by halving or doubling.
    """
    scales = cells.groupBy("source").agg(
        F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")),
                     F.sum(F.col("n") * F.col("size"))).alias("s"))
    at_cap = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = settled(
        sources.join(scales.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
            "source", "target", F.coalesce("s", F.lit(1.0)).alias("scale"),
            F.when((F.col("source_size") == 0) | ~at_cap, F.lit(0.0)).alias("lam"),
            F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
            ((F.col("source_size") == 0) | at_cap).alias("done")))
    for _ in range(NEWTON_ROUNDS):
        todo = state.filter("NOT done")
        x = F.col("size") / F.col("scale")
        tilt = F.col("lam") * x
        words = F.col("n") * F.col("size")
        sums = _beside(cells, todo, n_sources).groupBy("source").agg(
            F.sum(words * F.exp(F.least(tilt, F.lit(math.log(cap))))).alias("got"),
            F.coalesce(F.sum(F.when(tilt < math.log(cap), words * x * F.exp(tilt))), F.lit(0.0)).alias("slope"))
        df = state.join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        gap = F.col("got") - F.col("target")
        near = F.abs(gap) <= TOLERANCE * F.col("target") + 1e-3
        df = df.withColumns({"lo": F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")),
                             "hi": F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")),
                             "near": near, "step": F.col("lam") - F.try_divide(gap, F.col("slope"))})
        inside = F.col("step").isNotNull() & (F.isnull("lo") | (F.col("step") > F.col("lo"))) & (
            F.isnull("hi") | (F.col("step") < F.col("hi")))
        safe = F.when(F.isnull("hi"), 2 * F.abs("lo") + 1).when(F.isnull("lo"), -2 * F.abs("hi") - 1).otherwise(
            (F.col("lo") + F.col("hi")) / 2)
        far = F.abs(F.col("step") - F.col("lam")) > 4 * F.abs("lam") + 4  # where the slope is nearly flat
        new = F.when(inside & ~far, F.col("step")).otherwise(safe)
        state = settled(df.select(
            "source", "target", "scale", F.when(F.col("done") | F.col("near"), F.col("lam")).otherwise(new).alias("lam"),
            "lo", "hi", (F.col("done") | F.col("near")).alias("done")))
        if state.filter("NOT done").isEmpty():
            break
    return state.select("source", F.round("lam", 12).alias("lam"), "scale")


def _copies(moved: Column | None = None, cap: float = CAP) -> Column:
    """Copies of a document from its rate, hash position ``v`` and the source's shift."""
    plain = F.floor(rate("lam", "size", "scale", cap) + F.col("v") + F.col("shift"))
    out = F.greatest(F.lit(0), F.least(F.lit(int(cap)), plain))
    return (out if moved is None else out + moved).cast("long")


def _moved() -> Column:
    hits = F.size(F.filter("moved", lambda m: (m["h"] == F.col("h")) & (m["size"] == F.col("size"))))
    return F.col("sign") * hits


def fit(narrow: DataFrame, cap: float = CAP) -> tuple[DataFrame, int]:
    """What each source needs, and the number of sources, from rows (source, size, h)."""
    same = settled(narrow.groupBy("source", "size", "h").agg(F.count(F.lit(1)).alias("m")).withColumn("v", _position()))
    sizes = settled(same.groupBy("source").agg(F.sum(F.col("m") * F.col("size")).alias("source_size")))
    n = sizes.count()
    sources = settled(targets(sizes, cap=cap))
    cells = settled(same.groupBy("source", "size").agg(F.sum("m").alias("n")))
    solved = dual(cells, sources, n, cap)
    plan = settled(sources.join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
                   .drop("_s").withColumns({"shift": F.lit(0.0), "sign": F.lit(1),
                                            "moved": F.array().cast("array<struct<h:bigint,size:bigint>>")}))
    words = F.col("m") * F.col("size")

    def with_gap(plan):
        got = _beside(same, plan, n).groupBy("source").agg(F.sum(words * _copies(_moved(), cap)).alias("got"))
        return plan.join(got.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    # shift the threshold: whole buckets of the documents nearest to it
    plan = settled(with_gap(plan).withColumn("gap", F.col("target") - F.col("got")).withColumn(
        "sign", F.when(F.col("gap") < 0, -1).otherwise(1)).drop("got"))
    part = rate("lam", "size", "scale", cap) + F.col("v")
    part = part - F.floor(part)
    way = F.when(F.col("sign") > 0, 1 - part).otherwise(part)
    room = F.when(F.col("sign") > 0, _copies(None, cap) < cap).otherwise(_copies(None, cap) > 0)
    buckets = (_beside(same, plan, n).filter(room & (F.col("size") > 0))
               .groupBy("source", F.floor(way * BUCKETS).alias("b")).agg(F.sum(words).alias("words")))
    upto = buckets.withColumn("c", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
    upto = _beside(upto, plan.select("source", "gap"), n).filter(F.col("c") <= F.abs("gap"))
    edge = upto.groupBy("source").agg(((F.max("b") + 1) / BUCKETS).alias("edge"))
    plan = plan.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = settled(plan.withColumn("shift", F.col("sign") * F.coalesce("edge", F.lit(0.0))).drop("edge", "gap"))
    # then single documents, the largest that fits first
    for _ in range(MOVES):
        df = _beside(same, with_gap(plan), n).withColumn("left", F.abs(F.col("target") - F.col("got")))
        now = _copies(_moved(), cap)
        room = F.when(F.col("sign") > 0, now < cap).otherwise(now > 0)
        # a document that keeps the gap's sign, or makes the gap smaller by crossing it
        fits = (words > 0) & (words < 2 * F.col("left")) & ((F.col("target") - F.col("got")) * F.col("sign") > 0)
        best = df.filter(room & fits).groupBy("source").agg(F.min(F.struct(
            F.abs(F.col("left") - words).alias("rest"), "h", "size")).alias("best"))
        plan = plan.join(best.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
        plan = settled(plan.withColumn("moved", F.when(F.col("best").isNotNull(), F.concat("moved", F.array(
            F.struct(F.col("best.h").alias("h"), F.col("best.size").alias("size"))))).otherwise(F.col("moved")))
            .drop("_s", "best"))
    return plan, n


def _position() -> Column:
    """Hash position in [0, 1) of column ``h``."""
    return F.pmod(F.xxhash64("h", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        whole_rows: bool = False, cap: float = CAP) -> DataFrame:
    """``_row`` (the id, or the whole row) with size, source_size, target, copies and taken of each document."""
    rows = packed(docs, id_col, source_col, text_col)
    rows = rows.select("_row" if whole_rows else "_0", F.col("_1").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("_2", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64(F.col("_0").cast("string")).alias("h"))
    if not whole_rows:
        rows = settled(rows)
    plan, n = fit(rows.select("source", "size", "h"), cap)
    df = _beside(rows.withColumn("v", _position()), plan, n).withColumn("copies", _copies(_moved(), cap))
    return df.select("_row" if whole_rows else F.col("_0").alias(id_col), "size", "source_size", "target", "copies",
                     (F.col("copies") * F.col("size")).alias("taken"))
