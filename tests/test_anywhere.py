"""Queries run in a plain session: no configuration, another working folder, package not on the path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from conftest import DATA

REPO = Path(__file__).resolve().parent.parent
# the entry module is loaded by its file, and its folder leaves the workers' path again
RUN = """
import importlib.util, os, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name in sys.argv[3:]:
    print("ROWS", name, entry.queries()[name](spark, sys.argv[2]).count())
spark.stop()
"""


@pytest.mark.parametrize("names", [["a5_write_result", "d7_anomalies_grouped", "n1_stream_failed_rate"]])
def test_without_configuration(tmp_path, names):
    from __spark_entry__ import queries

    names = names + [n for n in queries() if n.startswith(("op2_", "op11_"))]
    for folder in ("conf", "work"):
        (tmp_path / folder).mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    done = subprocess.run([sys.executable, "-c", RUN, str(REPO / "__spark_entry__.py"), DATA, *names], cwd=tmp_path / "work", env=env,
                          capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = {x.split()[1]: int(x.split()[2]) for x in done.stdout.splitlines() if x.startswith("ROWS")}
    assert list(rows) == names and all(rows.values())
