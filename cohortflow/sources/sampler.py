"""Sampler files of any width, and the variable dictionary of a run.

A sampler writes one text file per chain: comment lines, one header line
with a name per column, one line of numbers per draw. A run has tens of
thousands of columns, so no column may become an expression of its own: a
line is split into an array, zipped with the ids that the header's names
stand for, and exploded. The plan has the same size for 48 and for 48,000
columns.

Names are parsed once: the dictionary of a run holds (var_id, variable,
base, indices), and the draws carry ``var_id`` and the base name, by which
the draws table is partitioned.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle

# a header cell with its quotes; names such as x[1,2] are quoted in CSV
CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'
ID_COLUMNS = ("run_id", "chain", "iteration")
# broadcast bounds: one row per file block, and the header arrays' total number of names
BLOCK_ROWS, HEADER_NAMES = 1_000_000, 5_000_000


class SamplerRun(NamedTuple):
    dictionary: DataFrame   # run_id, var_id, variable, base, indices
    draws: DataFrame        # run_id, base, var_id, chain, iteration, value
    short_lines: DataFrame  # run_id, file, n_lines: lines whose cells don't match the header (unfinished files)


def bracketed(name: Column) -> Column:
    """``x.1.2`` -> ``x[1,2]``; names with brackets or without indices stay."""
    dotted = name.rlike(r"^[^.\[]+(\.[0-9]+)+$")
    base = F.regexp_extract(name, r"^([^.]+)", 1)
    index = F.translate(F.regexp_extract(name, r"^[^.]+\.(.*)$", 1), ".", ",")
    return F.when(dotted, F.concat(base, F.lit("["), index, F.lit("]"))).otherwise(name)


def header_names(line: Column) -> Column:
    cells = F.regexp_extract_all(line, F.lit(CELL), F.lit(1))
    return F.transform(cells, lambda c: bracketed(F.replace(F.trim(F.trim(c), F.lit('"')), F.lit('""'), F.lit('"'))))


def dictionary_of(names: DataFrame) -> DataFrame:
    """(run_id, var_id, variable, base, indices) of a run's (run_id, variable, place) rows.

    Ids are 1, 2, ... in the header's order; a run's variables are its
    model's, some tens of thousands at most.
    """
    first = names.groupBy("run_id", "variable").agg(F.min("place").alias("place"))
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("place", "variable"))
    index = F.regexp_extract("variable", r"\[([0-9,]+)\]$", 1)
    return first.select(
        "run_id", number.alias("var_id"), "variable", F.regexp_extract("variable", r"^([^\[]+)", 1).alias("base"),
        F.when(index != "", F.transform(F.split(index, ","), lambda s: s.cast("int"))).alias("indices"))


def _checked(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def read_sampler(spark: SparkSession, path: str, run_id: str | None = None) -> SamplerRun:
    """Sampler files under ``path`` (a folder, also one partitioned by run_id or chain) as a run's tables.

    Lines that are empty or start with ``#`` are comments, wherever they
    stand. The first other line of a file is its header. The chain is a
    column, a folder ``chain=...`` or the file's place among its run's
    files by name; the iteration is a column or the line's place in its
    file. A cell that is no number gives NULL; lines with another number of
    cells than the header are left out and listed.
    """
    text = spark.read.text(path)
    run = F.col("run_id").cast("string") if "run_id" in text.columns else F.lit(run_id)
    lines = text.where(~F.col("value").rlike(r"^\s*(#|$)")).select(
        run.alias("run_id"), (F.col("chain").cast("int") if "chain" in text.columns else F.lit(None).cast("int")).alias("c"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("m"), "value")
    # one row per block of a file: where its lines begin, and how many came before in the file
    in_file = Window.partitionBy("run_id", "file").orderBy("block")
    blocks = lines.groupBy("run_id", "file", "block").agg(F.min("m").alias("m0"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumns({"before": F.coalesce(F.sum("n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)),
                                                      F.lit(0)), "k": F.row_number().over(in_file)})
    blocks = settle(blocks.withColumn("nth", F.dense_rank().over(Window.partitionBy("run_id").orderBy("file"))))
    n_blocks = blocks.count()
    heads = blocks.where("k = 1").select(F.col("file").alias("hf"), F.col("m0").alias("hm"))
    top = lines.join(_checked(heads, n_blocks, BLOCK_ROWS), (F.col("file") == F.col("hf")) & (F.col("m") == F.col("hm")))
    top = settle(top.select("run_id", "file", F.xxhash64("value").alias("header"), header_names(F.col("value")).alias("names")))
    names = top.select("run_id", F.posexplode("names").alias("place", "variable"))
    dictionary = settle(dictionary_of(names.where(~F.col("variable").isin(*ID_COLUMNS)).distinct()))
    # per header of a run: what each of its columns stands for, in the columns' order
    cells = top.dropDuplicates(["run_id", "header"]).select("run_id", "header", F.posexplode("names").alias("place", "variable"))
    meaning = cells.join(dictionary, ["run_id", "variable"], "left").groupBy("run_id", "header").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "var_id", "base"))),
                    lambda x: F.struct(x.var_id.alias("var_id"), x.base.alias("base"))).alias("columns"),
        *[F.max(F.when(F.col("variable") == c, F.col("place") + 1)).alias(f"at_{c}") for c in ("chain", "iteration")])
    meaning = settle(meaning)
    width = meaning.agg(F.sum(F.size("columns"))).first()[0] or 0
    places = blocks.join(top.select("file", "header"), "file").select(
        F.col("file").alias("bf"), F.col("block").alias("bb"), "m0", "before", "nth", "header")
    rows = lines.join(_checked(places, n_blocks, BLOCK_ROWS), (F.col("file") == F.col("bf")) & (F.col("block") == F.col("bb")))
    rows = rows.withColumn("line", F.col("m") - F.col("m0") + F.col("before")).where("line > 0")
    rows = rows.join(_checked(meaning.withColumnRenamed("run_id", "mr"), width, HEADER_NAMES).withColumnRenamed("header", "mh"),
                     F.col("run_id").eqNullSafe(F.col("mr")) & (F.col("header") == F.col("mh")))
    rows = rows.withColumn("cells", F.split("value", ","))
    whole = F.size("cells") == F.size("columns")
    given = lambda c: F.try_element_at("cells", F.col(f"at_{c}")).try_cast("int")
    long = rows.where(whole).select(
        "run_id", F.coalesce(given("chain"), "c", "nth").alias("chain"),
        F.coalesce(given("iteration"), F.col("line").cast("int")).alias("iteration"),
        F.inline_outer(F.arrays_zip(F.col("columns").alias("v"), F.col("cells").alias("x"))))
    draws = long.where(F.col("v.var_id").isNotNull()).select(
        "run_id", F.col("v.base").alias("base"), F.col("v.var_id").alias("var_id"), "chain", "iteration",
        F.col("x").try_cast("double").alias("value"))
    short = rows.where(~whole).groupBy("run_id", "file").agg(F.count(F.lit(1)).alias("n_lines"))
    return SamplerRun(dictionary, draws, short)


def sampler_lines(draws: DataFrame) -> DataFrame:
    """(run_id, chain, value): the text lines of sampler files for long draws, header first, with comments.

    The inverse of :func:`read_sampler`: one line per draw with a cell per
    variable of its run, empty where the draw has none; a group is one draw's variables.
    """
    names = draws.select("run_id", "variable").distinct()
    order = names.groupBy("run_id").agg(F.sort_array(F.collect_set("variable")).alias("all"))
    chains = draws.select("run_id", "chain").distinct().join(order, "run_id")
    head = chains.select("run_id", "chain", F.lit(-1).alias("iteration"), F.inline(F.array(
        F.struct(F.lit(0).alias("k"), F.lit("# method = sample").alias("value")),
        F.struct(F.lit(1).alias("k"), F.array_join(F.transform("all", lambda v: F.translate(v, "[,]", "..")), ",").alias("value")),
        F.struct(F.lit(2).alias("k"), F.lit("# Adaptation terminated").alias("value")))))
    lines = draws.groupBy("run_id", "chain", "iteration").agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "value"))).alias("cells")).join(order, "run_id")
    body = lines.select("run_id", "chain", "iteration", F.lit(0).alias("k"), F.array_join(F.transform(
        "all", lambda v: F.coalesce(F.element_at("cells", v).cast("string"), F.lit(""))), ",").alias("value"))
    return head.unionByName(body)


def write_sampler(draws: DataFrame, path: str) -> None:
    """One folder per run and chain, its lines in order, as a sampler leaves them."""
    lines = sampler_lines(draws).repartition("run_id", "chain").sortWithinPartitions("run_id", "chain", "iteration", "k")
    lines.select("run_id", "chain", "value").write.partitionBy("run_id", "chain").text(path)
