"""Readers and the run store (draws, summaries, mappings, reports).

A run artifact is three Parquet tables partitioned by ``run_id`` (data,
summary table, mappings) plus the draws themselves, so every run is its own
partition and re-running one run overwrites only its partition (dynamic
partition overwrite). Reading one run prunes the others at the scan.

Draws reach a run from several writers (a whole run, streams of finished
chains), so the ``draws`` table has one more partition column: ``part``, the
writer. Each writer replaces only what it wrote itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def all_string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_wide(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
              fmt: str = "parquet") -> DataFrame:
    """Wide rate table; with ``columns`` every column is read as text (the
    preamble rows of the spreadsheet exports are dropped before upload)."""
    reader = spark.read
    if columns is not None:
        reader = reader.schema(all_string_schema(columns))
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.parquet(path)


def export_header(spark: SparkSession, path: str, numbered: str) -> list[str]:
    """Column names of a wide export: the cells of its header line, the one that begins with ``numbered``.

    One line of the files reaches the driver. Files without it raise.
    """
    from .sampler import CELL
    lines = spark.read.text(path).where(F.regexp_replace(F.trim("value"), '^"', "").startswith(numbered))
    line = lines.agg(F.min("value")).first()[0]
    if line is None:
        raise ValueError(f"no header line that begins with {numbered!r} in {path}")
    cells = spark.range(1).select(F.regexp_extract_all(F.lit(line), F.lit(CELL), F.lit(1))).first()[0]
    return [c.strip().strip('"').replace('""', '"') for c in cells]


def read_numbered_wide(spark: SparkSession, path: str, columns: Sequence[str] | None = None, numbered: str = "Index",
                       rename: Mapping[str, str] | None = None) -> DataFrame:
    """Wide CSV export with preamble rows above its header, every column as text.

    The header line begins with the ``numbered`` column; ``columns`` gives
    the names by position where the files have none. Data rows are those
    whose ``numbered`` column holds an integer; preamble and header rows
    have none. ``rename`` maps long headers to the names used here.
    """
    names = list(columns) if columns is not None else export_header(spark, path, numbered)
    df = spark.read.schema(all_string_schema(names)).csv(path)
    df = df.where(F.col(f"`{numbered}`").try_cast("int").isNotNull())
    return df.withColumnsRenamed(dict(rename or {}))


def read_survey(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Lookup list CSV with a header row (small; joins against it are
    broadcast by AQE once its size is known)."""
    return spark.read.option("header", True).csv(path)


def read_draws(spark: SparkSession, path: str, layout: str = "long", run_id: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Sampler output -> long draws (run_id, variable, chain, iteration, value).

    ``layout='wide'`` expects one column per variable plus ``chain`` and
    ``iteration`` (the sampler's CSV layout). The value columns become one
    array of (name, value) structs and are exploded, so a row is read once
    however many variables there are.
    """
    df = spark.read.option("header", True).option("inferSchema", False).csv(path) \
        if fmt == "csv" else spark.read.parquet(path)
    if layout == "wide":
        ids = [c for c in ("run_id", "chain", "iteration") if c in df.columns]
        values = [c for c in df.columns if c not in ids]
        pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("value"))
                          for c in values])
        df = df.select(*ids, F.inline(pairs))
    if run_id is not None and "run_id" not in df.columns:
        df = df.withColumn("run_id", F.lit(run_id))
    return df.select("run_id", "variable", F.col("chain").cast("int").alias("chain"),
                     F.col("iteration").cast("int").alias("iteration"),
                     F.col("value").cast("double").alias("value"))


def default_root(spark: SparkSession) -> str:
    """Run store under the cluster's shared checkpoint folder."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/runs"


def write_run(spark: SparkSession, run_id: str, tables: Mapping[str, DataFrame],
              root: str | None = None) -> str:
    """Write each table of a run under ``root/<name>/run_id=<run_id>``.

    Dynamic partition overwrite replaces only this run's partition.
    """
    return write_runs(spark, {name: df.withColumn("run_id", F.lit(run_id)) if "run_id" not in df.columns else df
                              for name, df in tables.items()}, root)


def write_runs(spark: SparkSession, tables: Mapping[str, DataFrame], root: str | None = None) -> str:
    """Write tables of any number of runs (column ``run_id``), one partitioned write each.

    Only the partitions of the runs at hand are replaced.
    """
    root = root or default_root(spark)
    for name, df in tables.items():
        if name == "draws":
            write_draws(df, root, WHOLE_RUN)
        else:
            (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
             .parquet(f"{root}/{name}"))
    return root


WHOLE_RUN = "run"


def write_draws(draws: DataFrame, root: str, part: str) -> None:
    """Draws of any runs from one writer; what this writer wrote for these runs before is replaced, nothing else."""
    (draws.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "part").parquet(f"{root}/draws"))


def write_mappings(spark: SparkSession, run_id: str, mappings: Mapping[str, DataFrame] |
                   Sequence[tuple[str, DataFrame]], root: str | None = None) -> str:
    """Ordered (name, dimension) mappings as one table with their order."""
    items = list(mappings.items()) if isinstance(mappings, Mapping) else list(mappings)
    df = None
    for i, (name, dim) in enumerate(items, start=1):
        d = dim.select(F.lit(name).alias("mapping"), F.lit(i).alias("ordinal"),
                       F.col("number").cast("int"), F.col("value").cast("int"))
        df = d if df is None else df.unionByName(d)
    return write_run(spark, run_id, {"mappings": df}, root)


def read_run(spark: SparkSession, name: str, run_id: str | Sequence[str] | None = None,
             root: str | None = None) -> DataFrame:
    """One table of one or several runs (partition-pruned)."""
    root = root or default_root(spark)
    df = spark.read.parquet(f"{root}/{name}")
    if name == "draws":
        df = df.drop("part")
    if run_id is None:
        return df
    ids = [run_id] if isinstance(run_id, str) else list(run_id)
    return df.where(F.col("run_id").isin(ids))


def read_mapping(spark: SparkSession, run_id: str, name: str, root: str | None = None) -> DataFrame:
    m = read_run(spark, "mappings", run_id, root)
    return m.where(F.col("mapping") == name).select("number", "value")


def write_report(df: DataFrame, path: str, sort: Sequence[str] | None = None) -> None:
    """Small report table -> one CSV file with a header (sorted first)."""
    out = df.orderBy(*sort) if sort else df
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
