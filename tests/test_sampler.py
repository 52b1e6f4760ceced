"""Sampler files by their header, and the bucketed draws table."""

import time

import pytest

from cohortflow.operators import diagnostics
from cohortflow.sources import draws_table, sampler


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comments_names_chains_and_short_lines(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "m-1.csv").write_text("# model = m\nlp__,x.1.2,tau\n# Adaptation terminated\n-1.5,0.25,1\n-2,0.5,nan\n#  5 seconds\n")
    (run / "m-2.csv").write_text('# model\n\nlp__,"x[1,2]",tau\n1,2,3\n4,abc,6\n7,8')
    got = sampler.read_sampler(spark, str(run), run_id="r")
    words = {r.variable: (r.var_id, r.base, r.indices, r.run_id) for r in got.dictionary.collect()}
    assert words == {"lp__": (1, "lp__", None, "r"), "x[1,2]": (2, "x", [1, 2], "r"), "tau": (3, "tau", None, "r")}
    rows = {(r.var_id, r.chain, r.iteration): r.value for r in got.draws.collect()}
    assert rows[2, 1, 1] == 0.25 and rows[2, 1, 2] == 0.5 and rows[3, 1, 2] != rows[3, 1, 2]
    assert rows[1, 2, 1] == 1 and rows[2, 2, 2] is None and len(rows) == 12
    assert [(r.n_lines, r.file[-7:]) for r in got.short_lines.collect()] == [(1, "m-2.csv")]


def test_id_columns_folders_and_runs(spark, tmp_path):
    for r, c in (("a", 1), ("a", 2), ("b", 1)):
        d = tmp_path / f"run_id={r}" / f"chain={c}"
        d.mkdir(parents=True)
        (d / "out.csv").write_text("iteration,y,z.1\n" + "".join(f"{i},{i}.5,{c}\n" for i in (10, 20)))
    got = sampler.read_sampler(spark, str(tmp_path))
    rows = {(r.run_id, r.base, r.chain, r.iteration): r.value for r in got.draws.collect()}
    assert len(rows) == 12 and rows["a", "y", 2, 20] == 20.5 and rows["b", "z", 1, 10] == 1
    assert got.dictionary.count() == 4 and got.short_lines.isEmpty()


def test_lines_are_counted_over_the_blocks_of_a_file(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text("# c\nv\n" + "".join(f"{i}\n# gap\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = sampler.read_sampler(spark, str(p), "r").draws.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.iteration, r.value) for r in rows) == [(i, float(i)) for i in range(1, 3001)]


def test_many_columns_are_planned_quickly(spark, tmp_path):
    n = 27_000
    p = tmp_path / "wide.csv"
    names = [f"pop.{1 + k // 100}.{1 + k % 100}" for k in range(n)]
    with open(p, "w") as f:
        f.write(",".join(names) + "\n")
        for i in range(3):
            f.write(",".join(str(k + i / 4) for k in range(n)) + "\n")
    got = sampler.read_sampler(spark, str(p), "r")
    at = time.time()
    got.draws._jdf.queryExecution().executedPlan()
    assert time.time() - at < 5
    assert "BatchScan" in plan(got.draws) or "FileScan text" in plan(got.draws)
    out = got.draws.groupBy("base").agg({"value": "sum", "*": "count"}).first()
    assert out["count(1)"] == 3 * n and out["sum(value)"] == pytest.approx(3 * n * (n - 1) / 2 + n * 0.75)
    assert got.dictionary.where("var_id = 27000").first().indices == [270, 100]


@pytest.fixture
def table(spark, tmp_path):
    rows = [(r, f"{v}[{i}]", c, k, float(k % 17 + i + c)) for r in ("a", "b") for v in ("x", "y") for i in (1, 2, 3)
            for c in (1, 2) for k in range(1, 21)]
    d = spark.createDataFrame(rows, "run_id string, variable string, chain int, iteration int, value double")
    name = "t_" + tmp_path.name.replace("-", "_")
    draws_table.open_table(spark, name, str(tmp_path), buckets=4)
    draws_table.write_runs(spark, name, draws_table.keyed(d), buckets=4)
    yield name, d, str(tmp_path)
    draws_table.drop_table(spark, name)


def test_statistics_need_no_exchange_of_draws(spark, table):
    name, d, _ = table
    from cohortflow.operators import draws
    by = ["run_id", "var_id"]
    rows = draws_table.read_runs(spark, name)
    z = diagnostics.rank_normalise(diagnostics.split_chains(rows, by, clustered=True), by)
    for df in (draws.summarise_draws(rows, by=by), diagnostics.rhat(rows, by, z), diagnostics.ess(rows, by, z)):
        assert "Exchange" not in plan(df), plan(df)
    got = draws_table.summarise(spark, name, diagnostics=True)
    want = draws.summarise_draws(d, diagnostics=True)
    key = lambda df: sorted(map(tuple, df.select("run_id", "variable", "mean", "q50", "rhat", "ess_bulk").collect()))
    assert key(got) == key(want)


def test_runs_and_base_names_prune_folders(spark, table):
    name, _, path = table
    p = plan(draws_table.read_runs(spark, name, ["a"], ["x"]))
    pruned = p.split("PartitionFilters: [")[1].split("]")[0]
    assert "run_id" in pruned and "base" in pruned
    assert "regexp" not in plan(draws_table.extract(spark, name, "x", ["i"])).lower()
    out = draws_table.extract(spark, name, "x", ["i"], run_ids=["a"]).collect()
    assert sorted((r.run_id, r.variable, r.i) for r in out) == [("a", f"x[{i}]", i) for i in (1, 2, 3)]
    # a run written again replaces its own partitions; another session opens the folder anew
    one = spark.createDataFrame([("a", "x[1]", 1, 1, 5.0)], "run_id string, variable string, chain int, iteration int, value double")
    draws_table.write_runs(spark, name, draws_table.keyed(one), buckets=4)
    draws_table.drop_table(spark, name)
    draws_table.open_table(spark, name, path, buckets=4)
    counts = {(r.run_id, r.base): r["count"] for r in draws_table.read_runs(spark, name).groupBy("run_id", "base").count().collect()}
    assert counts == {("a", "x"): 1, ("a", "y"): 120, ("b", "x"): 120, ("b", "y"): 120}
