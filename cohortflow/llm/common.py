"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import sys

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed by the operators' contracts: a word between ASCII white space, and a
# word of letters and digits of any script.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so that executors need no copy of this package.

    This holds for functions in a plan. What is broadcast would be pickled
    by reference to its class; :func:`share` sends it by value too.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object of this package's classes as plain bytes."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast):
    """The object behind :func:`share`; a Python worker opens it once and keeps it for its later tasks."""
    value = getattr(shared, "_opened", None)
    if value is None:
        value = shared._opened = pickle.loads(shared.value)
    return value


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z only (``lower`` would also change other scripts)."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column | str) -> Column:
    """The words of a text; none for a null text."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")),
                                F.lit(SPACE_WORD), F.lit(0))


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, renamed by position to ``_0, _1, ...``, and the whole row as struct ``_row``.

    Operators work beside ``_row`` and unpack it at the end, so the caller's
    columns can have any name without a clash.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)])


def unpacked(df: DataFrame, *extra: Column) -> DataFrame:
    return df.select("_row.*", *extra)


def once(df: DataFrame, kept: list, **computed: Column) -> DataFrame:
    """``kept`` columns with ``computed`` ones that are evaluated once a row.

    They come out of a generator, so the optimizer doesn't copy a costly
    expression into filters above it or into lambdas that use its result.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in computed.items()]))))


BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table of narrow rows, to be broadcast while it has at most ``limit`` rows.

    A larger one is joined by a shuffle, where Spark can split hot keys.
    """
    return F.broadcast(df) if df.count() <= limit else df


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of ``keys``.

    The table is counted first and a hash threshold keeps about ``4 n`` rows,
    so what the tasks send to the driver doesn't grow with their number.
    """
    total = df.count()
    share = min(1.0, 4 * n / total) if total else 1.0
    rows = df.withColumn("_pick", F.pmod(F.xxhash64(*keys), F.lit(1 << 40)))
    return rows.filter(F.col("_pick") < int(share * (1 << 40)) + 1).orderBy("_pick", *keys).limit(n).drop("_pick")


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder: cuts the lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


ship(__name__)
