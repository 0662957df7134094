"""The engine without the corpus operators: their folders are taken out of a copy, the pipeline's file stays."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert "composite_medoid" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
assert set(e.oracle_sql()) <= names
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
print("works")
"""


def test_queries_and_entry_survive(tmp_path):
    for name in ("rastertime", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "works" in done.stdout, done.stderr[-2000:]
