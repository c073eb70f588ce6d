"""The entry without the folders that may be deleted."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
RUN = """
import __spark_entry__ as contract
from delaylake.plans.checks import QUERIES
assert set(contract.queries()) == set(QUERIES), set(contract.queries()) ^ set(QUERIES)
assert set(contract.oracle_sql()) <= set(QUERIES)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert contract.queries()["event_json_parse"](spark, "/root/testdata/sf0.001").count() > 0
"""


@pytest.mark.parametrize("without", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_subpackage(tmp_path, without):
    gone = {"llm", ".git", "__pycache__", *without}
    home = tmp_path / "copy"
    shutil.copytree(ROOT, home, ignore=lambda _, names: gone & set(names))
    assert not (home / "delaylake/llm").exists()
    done = subprocess.run(
        [sys.executable, "-c", RUN], cwd=home, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
