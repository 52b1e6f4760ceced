"""The queries run where only the driver can import this package."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cf-workers-")).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as e

def missing(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("cohortflow") is None] * b.num_rows)], names=["m"])

assert spark.range(1).mapInArrow(missing, "m boolean").first()[0], "the workers can import the package"
for name in sys.argv[1:]:
    print("ROWS", name, len(e.queries()[name](spark, "/root/testdata/sf0.001").collect()), flush=True)
"""


def test_queries_run_with_the_package_on_the_driver_only(tmp_path):
    pytest.importorskip("public_tokenizers")
    names = ["op1_decontaminate", "op3_html_extract", "op4_quality_model", "op5_token_counts", "op8_simhash",
             "op9_line_dedup", "op10_suffix_dedup", "op11_fingerprints", "op12_centroids", "ess_bulk", "convergence_events"]
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = dict(line.split()[1:3] for line in out.stdout.splitlines() if line.startswith("ROWS"))
    assert set(rows) == set(names), out.stdout[-2000:] + out.stderr[-4000:]
    assert all(int(n) > 0 for n in rows.values())
