"""Draws of many runs as one table, partitioned by run and base name and bucketed by variable.

Every statistic of draws groups by variable. In this table a variable's
draws lie in one bucket, so summaries, R-hat and ESS read it without an
exchange; a filter on the run or on a base name prunes folders before
anything is read. Draws keep the variable's number, names and indices are in
the dictionary, one row per variable and run.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import draws as D
from ..session import make_folder
from .sampler import SamplerRun, dictionary_of

BUCKETS = 32
# dictionary rows that are broadcast: some 100 bytes each
DICTIONARY_ROWS = 500_000


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _names(name: str) -> tuple[str, str]:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a table name: {name}")
    return f"{name}_draws", f"{name}_variables"


def open_table(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Register (and where new, create) the tables ``<name>_draws`` and ``<name>_variables`` over a shared folder."""
    draws, variables = _names(name)
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {draws}
        (var_id INT, chain INT, iteration INT, value DOUBLE, run_id STRING, base STRING)
        USING parquet PARTITIONED BY (run_id, base)
        CLUSTERED BY (var_id) SORTED BY (var_id, chain, iteration) INTO {int(buckets)} BUCKETS
        LOCATION '{path}/draws'""")
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {variables}
        (var_id INT, variable STRING, base STRING, indices ARRAY<INT>, run_id STRING)
        USING parquet PARTITIONED BY (run_id) LOCATION '{path}/variables'""")
    for t, folder in ((draws, "draws"), (variables, "variables")):
        make_folder(spark, f"{path}/{folder}")
        spark.catalog.recoverPartitions(t)


def drop_table(spark: SparkSession, name: str) -> None:
    """Forget the tables; their folder stays."""
    for t in _names(name):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def keyed(draws: DataFrame) -> SamplerRun:
    """Long draws with names -> dictionary and draws with numbers; each name is parsed once."""
    names = draws.groupBy("run_id", "variable").agg(F.lit(0).alias("place"))
    dictionary = dictionary_of(names)
    known = dictionary.select("run_id", "variable", "var_id", "base")
    out = draws.join(known, ["run_id", "variable"]).select("run_id", "base", "var_id", "chain", "iteration", "value")
    return SamplerRun(dictionary, out, draws.limit(0))


def write_runs(spark: SparkSession, name: str, run: SamplerRun, buckets: int = BUCKETS) -> None:
    """Put runs into the table; partitions (run, base name) that were there are replaced.

    One exchange by bucket, so each bucket of a partition is one file, in order.
    """
    draws, variables = _names(name)
    rows = run.draws.repartition(buckets, "var_id").sortWithinPartitions("run_id", "base", "var_id", "chain", "iteration")
    with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        rows.select("var_id", "chain", "iteration", "value", "run_id", "base").write.mode("overwrite").insertInto(draws)
        run.dictionary.select("var_id", "variable", "base", "indices", "run_id").write.mode("overwrite").insertInto(variables)


def read_runs(spark: SparkSession, name: str, run_ids: Sequence[str] | None = None,
              bases: Sequence[str] | None = None) -> DataFrame:
    """(run_id, base, var_id, chain, iteration, value), pruned by folder, still bucketed by variable."""
    df = spark.table(_names(name)[0])
    if run_ids is not None:
        df = df.where(F.col("run_id").isin(list(run_ids)))
    if bases is not None:
        df = df.where(F.col("base").isin(list(bases)))
    return df.select("run_id", "base", "var_id", "chain", "iteration", "value")


def variables(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(_names(name)[1]).select("run_id", "var_id", "variable", "base", "indices")


def named(spark: SparkSession, name: str, stats: DataFrame) -> DataFrame:
    """Statistics keyed by (run_id, var_id) with the variable's name, base name and indices."""
    v = variables(spark, name)
    if v.count() <= DICTIONARY_ROWS:
        v = F.broadcast(v)
    return stats.join(v, ["run_id", "var_id"])


def summarise(spark: SparkSession, name: str, run_ids: Sequence[str] | None = None, bases: Sequence[str] | None = None,
              probs: Sequence[float] = D.DEFAULT_PROBS, diagnostics: bool = False) -> DataFrame:
    """Summary of every variable of the runs, without an exchange of draws; names are joined to the result."""
    from ..operators.diagnostics import convergence
    rows, by = read_runs(spark, name, run_ids, bases), ["run_id", "var_id"]
    out = D.summarise_draws(rows, probs, by=by)
    if diagnostics:
        out = out.join(convergence(rows, by, clustered=True), by, "left")
    return named(spark, name, out)


def extract(spark: SparkSession, name: str, base: str, indices: Sequence[str], run_ids: Sequence[str] | None = None,
            probs: Sequence[float] = D.DEFAULT_PROBS, mappings=None) -> DataFrame:
    """Summary of one parameter with its indices as columns, from the dictionary instead of its names.

    ``mappings`` recodes index columns as in :func:`operators.draws.extract_indexed`.
    """
    out = summarise(spark, name, run_ids, [base], probs)
    out = out.select(*[c for c in out.columns if c not in ("var_id", "base", "indices")],
                     *[F.get("indices", i).alias(c) for i, c in enumerate(indices)])
    for column, dim in dict(mappings or {}).items():
        out = D.apply_mapping(out, column, dim)
    return out
