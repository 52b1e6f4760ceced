import os
import shutil
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortflow.sources import store
from cohortflow.streaming import ingest
from tests.harness import compare, duck_connect


def _draws(spark, run, n=40):
    rows = [(run, f"total_pop[{t}]", 1 + i % 4, i // 4 + 1, float(t * 100 + i)) for t in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, variable string, chain int, iteration int, value double")


def test_run_store_roundtrip_and_partition_overwrite(spark):
    root = tempfile.mkdtemp(prefix="cf-store-")
    store.write_run(spark, "a", {"draws": _draws(spark, "a")}, root)
    store.write_run(spark, "b", {"draws": _draws(spark, "b")}, root)
    store.write_run(spark, "a", {"draws": _draws(spark, "a", n=8)}, root)   # replaces run a only
    d = store.read_run(spark, "draws", root=root)
    counts = {r.run_id: r["count"] for r in d.groupBy("run_id").count().collect()}
    assert counts == {"a": 16, "b": 80}
    plan = store.read_run(spark, "draws", "b", root)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    year = spark.createDataFrame([(1, 1950), (2, 1955)], "number int, value int")
    store.write_mappings(spark, "a", [("year", year)], root)
    assert sorted(tuple(r) for r in store.read_mapping(spark, "a", "year", root).collect()) == [(1, 1950), (2, 1955)]


def test_read_draws_wide(spark):
    path = tempfile.mkdtemp(prefix="cf-wide-") + "/w"
    spark.createDataFrame([(1, 1, 0.5, 2.0), (1, 2, 0.6, 2.1)],
                          "chain int, iteration int, `x[1]` double, lp__ double").write.parquet(path)
    d = store.read_draws(spark, path, layout="wide", run_id="r").collect()
    assert {(r.variable, r.iteration) for r in d} == {("x[1]", 1), ("x[1]", 2), ("lp__", 1), ("lp__", 2)}


def test_report_csv(spark):
    out = tempfile.mkdtemp(prefix="cf-rep-") + "/report"
    df = spark.createDataFrame([("b", 1950, 1.0), ("a", 1955, 2.0)], "survey string, year int, mean double")
    store.write_report(df, out, sort=["survey", "year"])
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1
    lines = open(os.path.join(out, files[0])).read().splitlines()
    assert lines[0] == "survey,year,mean" and lines[1].startswith("a,")


def test_stream_ingest_exactly_once(spark):
    src = tempfile.mkdtemp(prefix="cf-src-")
    root = tempfile.mkdtemp(prefix="cf-root-")
    ckpt = tempfile.mkdtemp(prefix="cf-ck-")
    _draws(spark, "s").where("chain = 1").write.mode("append").parquet(src)
    q = ingest.ingest_draws(spark, src, ckpt, root)
    q.awaitTermination(120)
    _draws(spark, "s").where("chain = 2").write.mode("append").parquet(src)
    q = ingest.ingest_draws(spark, src, ckpt, root)      # restart: only the new file
    q.awaitTermination(120)
    d = store.read_run(spark, "draws", "s", root)
    assert d.count() == 40
    assert d.select("chain").distinct().count() == 2


def test_run_and_two_streams_share_the_draws_table(spark, tmp_path):
    """A whole run and two streams, both of which count batches from 0, write the same run: nothing is lost."""
    root = str(tmp_path / "store")
    store.write_run(spark, "s", {"draws": _draws(spark, "s").where("chain = 1")}, root)
    for k, chain in (("a", 2), ("b", 3)):
        src = str(tmp_path / f"src-{k}")
        _draws(spark, "s").where(f"chain = {chain}").write.parquet(src)
        for _ in range(2):  # a restart finds nothing new
            ingest.ingest_draws(spark, src, str(tmp_path / f"ck-{k}"), root).awaitTermination(120)
    d = store.read_run(spark, "draws", "s", root)
    assert d.columns == ["variable", "chain", "iteration", "value", "run_id"]
    assert {r.chain: r["count"] for r in d.groupBy("chain").count().collect()} == {1: 20, 2: 20, 3: 20}
    store.write_run(spark, "s", {"draws": _draws(spark, "s", n=8).where("chain = 1")}, root)  # replaces its own part
    assert store.read_run(spark, "draws", "s", root).where("chain = 1").count() == 4
    assert store.read_run(spark, "draws", "s", root).count() == 44


def test_read_wide_csv_all_text_and_lookup(spark):
    from cohortflow.operators import rates, survey
    d = tempfile.mkdtemp(prefix="cf-csv-")
    with open(os.path.join(d, "wide.csv"), "w") as f:
        f.write("region,period,0-4,5-9,100+,Notes\nA,1950,120.5,98.0,0.1,\nA,1955,x,101.2,0.2,n\n")
    with open(os.path.join(d, "tribes.csv"), "w") as f:
        f.write("Tribe name\nL1\n")
    cols = ["region", "period", "0-4", "5-9", "100+", "Notes"]
    wide = store.read_wide(spark, os.path.join(d, "wide.csv"), columns=cols, fmt="csv")
    assert all(t == "string" for _, t in wide.dtypes)
    long = {(r.year, r.age): r.pop for r in rates.tidy_rates(wide, "pop").collect()}
    assert long[(1950, 100)] == 0.1 and long[(1955, 0)] is None   # bad text -> NULL
    lookup = store.read_lookup(spark, os.path.join(d, "tribes.csv"))
    df = spark.createDataFrame([("L1",), ("X",), (None,)], "tribe string")
    kept = survey.exclude_listed(df, lookup, "tribe", "Tribe name").collect()
    assert sorted(str(r.tribe) for r in kept) == ["None", "X"]


def test_read_numbered_wide_skips_the_preamble(spark, tmp_path):
    from cohortflow.operators import rates
    path = tmp_path / "w.csv"
    path.write_text("United Nations\nsome, note\n,,\nIndex,Region name,Reference date,0-4,100+\n"
                    "1,A,1950,120.5,0.1\n2,B,1950,7,x\n")
    cols = ["Index", "Region name", "Reference date", "0-4", "100+"]
    df = store.read_numbered_wide(spark, str(path), cols, "Index", {"Region name": "region", "Reference date": "period"})
    long = {(r.region, r.age): r.pop for r in rates.tidy_rates(df.drop("Index"), "pop").collect()}
    assert long == {("A", 0): 120.5, ("A", 100): 0.1, ("B", 0): 7.0, ("B", 100): None}
    by_header = store.read_numbered_wide(spark, str(path))
    assert by_header.columns == cols and by_header.count() == 2
    path.write_text("no header here\n")
    with pytest.raises(ValueError, match="Index"):
        store.read_numbered_wide(spark, str(path))


@pytest.fixture
def several_runs(tmp_path):
    """The sf0.001 tables with half of the vec_ids at 2000 and above, so draws fall into several runs."""
    folder = shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf", copy_function=shutil.copyfile)
    vectors = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    ids = [k if k < 250 else k + 1750 for k in vectors.column("vec_id").to_pylist()]
    vectors = vectors.set_column(vectors.schema.get_field_index("vec_id"), "vec_id", pa.array(ids, pa.int64()))
    pq.write_table(vectors, folder / "embeddings.parquet")
    return str(folder)


def _same_as_sql(spark, folder, name):
    import __spark_entry__ as e
    res = compare(spark, duck_connect(folder), folder, name, e.queries()[name], e.oracle_sql()[name])
    assert res["status"] == "ok", res


def test_run_store_roundtrip_reads_every_run(spark, several_runs):
    _same_as_sql(spark, several_runs, "run_store_roundtrip")


def test_sources_roundtrip_keeps_every_run(spark, several_runs):
    _same_as_sql(spark, several_runs, "sources_roundtrip")
