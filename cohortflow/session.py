"""Spark session defaults and small plan helpers shared by every module."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _builder(cpus):
    """A local master only where none is configured (a cluster submit sets its own)."""
    if SparkConf().contains("spark.master"):
        return SparkSession.builder
    return SparkSession.builder.master(f"local[{cpus}]")


def get_spark(app: str = "cohortflow", cpus: str | int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session tuned for this engine; reuses an active session if present."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (8 if cpus == "*" else max(2, int(cpus)))
    spark = (
        _builder(cpus)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins against dimensions become broadcasts only after AQE has
        # measured the materialised side against this size (bytes)
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a shared folder and is used as is. Where
    it is unset, a session that runs in one process (tests) gets a scratch
    folder; on a cluster that would be one machine's disk, so it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the cluster's setting is all there is
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        master = sc.master if sc is not None else ""
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="cohortflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder: cuts the lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a shared folder if it is missing, through the file system that its path names."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(where)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote, through the file system that its path names."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used where results are compared by hash)."""
    cols = []
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(field.name).cast("double"), digits).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def balance(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows over every core before compute-heavy row operators.

    The (population, draw) rows are few bytes but many CPU-seconds each
    (array folds); AQE would coalesce their small shuffle into one task.
    An explicit partition count (cores, or the shuffle partitions if more) is kept as is,
    and hashing on (population, draw) spreads a hot population evenly.
    """
    spark = df.sparkSession
    try:
        want = spark.sparkContext.defaultParallelism
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        want = 0
    # a cluster sizes its shuffle partitions by the data; that holds here too
    want = max(want, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(want, *keys)
