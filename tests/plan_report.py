"""Summarise the physical plans of the headline queries into PLANS.md.

Usage: python tests/plan_report.py [sf_dir]   (default /root/testdata/sf0.01)

Plans are taken with AQE off (the static plan Catalyst produces); at run
time AQE may further coalesce partitions, switch joins to broadcast after
measuring, and reuse exchanges.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = [
    ("shuffle exchanges", r"Exchange hashpartitioning"),
    ("range exchanges", r"Exchange rangepartitioning"),
    ("broadcast exchanges", r"BroadcastExchange"),
    ("sort-merge joins", r"SortMergeJoin"),
    ("broadcast hash joins", r"BroadcastHashJoin"),
    ("windows", r"\bWindow \["),
    ("hash aggregates", r"HashAggregate\("),
    ("grouped maps (pandas)", r"FlatMapGroupsInPandas"),
    ("generates (explode)", r"\bGenerate "),
    ("parquet scans", r"FileScan parquet|Scan parquet"),
    ("checkpoint reads", r"ExistingRDD|LogicalRDD|Scan ExistingRDD"),
]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as entry
    from bench import HEADLINE
    from cohortflow.session import get_spark

    spark = get_spark()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out = ["# Physical plans of the headline queries", "",
           f"Static plans (AQE off) at `{sf_dir}`, produced by `tests/plan_report.py`.",
           "Checkpointed inputs (the shared rate aggregate and the survival table) appear",
           "as RDD scans: the fact tables behind them were read once, by the checkpoint job.", ""]
    header = "| query | " + " | ".join(n for n, _ in OPS) + " |"
    out += [header, "|" + " --- |" * (len(OPS) + 1)]
    schemas = {}
    for name in HEADLINE + ["summarise_full", "project_migrants", "score_observations"]:
        df = entry.queries()[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(p, plan))) for _, p in OPS]
        out.append(f"| {name} | " + " | ".join(counts) + " |")
        schemas[name] = sorted(set(re.findall(r"ReadSchema: (struct<.*>)\s*$", plan, flags=re.M)))
    out += ["", "## Columns read from parquet (ReadSchema)", ""]
    for name, sch in schemas.items():
        out.append(f"* `{name}`: " + ("; ".join(f"`{s}`" for s in sch) if sch else "checkpointed inputs only"))
    from cohortflow.sources.fixtures import fixture
    base = fixture(spark, sf_dir, "v_rate_base")
    out += ["", "## The shared rate aggregate (read once per query, then checkpointed)", "", "```"]
    text = base._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    out += [ln for ln in text.split("\n") if ln.startswith("(") or "PushedFilters" in ln or "ReadSchema" in ln
            or "Join type" in ln or ln.startswith("+-") or ln.startswith("*") or ln.startswith(":")]
    out += ["```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(f"wrote {path}")


if __name__ == "__main__":
    main(sys.argv)
