"""Global positions and running sums against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from cohortflow.operators.ordering import numbered


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in several partitions, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_of_groups_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k if k % 7 else None, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long, k long")
    out = numbered(df, ["g"], [F.desc_nulls_last("x"), F.col("k")]).collect()
    by = {}
    for g, x, k in rows:
        by.setdefault(g, []).append((x is None, -(x or 0), k))
    want = {(g, r[2]): (i, len(v)) for g, v in by.items() for i, r in enumerate(sorted(v))}
    assert len(out) == len(rows)
    assert {(r.g, r.k): (r.before, r.total) for r in out} == want
    # a group is spread over partitions, not gathered
    assert df.repartitionByRange("g", "x").select("g", F.spark_partition_id().alias("p")) \
        .where("g = 'a'").distinct().count() > 3


def test_running_weights_and_empty_table(spark):
    rows = [("a", v, v % 3) for v in range(500)] + [("b", 1, 5)]
    df = spark.createDataFrame(rows, "g string, v int, before int")
    out = {(r[0], r[1]): (r["w"], r["n"]) for r in
           numbered(df, ["g"], ["v"], weight="before", before="w", total="n").collect()}
    acc = 0
    for v in range(500):
        assert out[("a", v)] == (acc, sum(k % 3 for k in range(500)))
        acc += v % 3
    assert out[("b", 1)] == (0, 5)
    assert numbered(df.limit(0), ["g"], ["v"]).count() == 0
