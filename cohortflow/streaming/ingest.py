"""Incremental ingest of sampler output into the run store.

Chains finish at different times; each finished chain's draws file is
picked up by a file-source stream and appended to the ``draws`` table of
the run store. A micro-batch may be run again after a failure, so each is a
writer of its own in the store's layout (partitions ``run_id, part``) with
dynamic overwrite: a replay replaces what the first attempt wrote and never
duplicates draws. The writer's name holds the stream's name too, so streams
with checkpoints of their own, which all count batches from 0, don't replace
each other's draws. Summaries are then batch queries over the store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import default_root, write_draws

DRAWS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("chain", T.IntegerType()),
    T.StructField("iteration", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])


def draws_stream(spark: SparkSession, source_dir: str, schema: T.StructType = DRAWS_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def write_draws_batch(batch: DataFrame, batch_id: int, root: str, stream: str) -> None:
    """Idempotent write of one micro-batch: its partitions are replaced as a whole."""
    write_draws(batch, root, f"{stream}-{batch_id}")


def ingest_draws(spark: SparkSession, source_dir: str, checkpoint: str, root: str | None = None,
                 available_now: bool = True, stream: str | None = None):
    """Add newly arrived draws files to ``root/draws`` (partitioned by run and writer).

    ``stream`` names this stream in the store; by default its checkpoint
    folder does. Returns the started ``StreamingQuery``; with
    ``available_now`` it stops after the files present at start are processed.
    """
    root = root or default_root(spark)
    stream = stream or "stream-" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write_draws_batch(batch, batch_id, root, stream)

    writer = draws_stream(spark, source_dir).writeStream.foreachBatch(write_batch) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
