"""The driver contract with and without the training-data operators, and the package on executors."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def test_entry_works_without_the_training_data_operators(tmp_path):
    out = run(f"""
import sys
sys.path.insert(0, {ROOT!r})
sys.modules["corpus_pipeline"] = None
sys.modules["venuelens.llm"] = None
import __spark_entry__ as e
names = e.queries()
assert names and set(e.oracle_sql()) <= set(names) and not any(n.startswith("op") or n == "pipeline" for n in names)
""", tmp_path)
    assert out.returncode == 0, out.stderr


def test_jobs_started_in_another_folder_find_the_package(tmp_path):
    out = run(f"""
import sys
sys.path.insert(0, {ROOT!r})
from venuelens.session import build_session
spark = build_session("elsewhere", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
from venuelens.plans.catalog import QUERIES
assert QUERIES["i1_batch_scoring"](spark, "/root/testdata/sf0.001").count() == 200
assert QUERIES["k1_chi2_p"](spark, "/root/testdata/sf0.001").count() == 1
spark.stop()
""", tmp_path)
    assert out.returncode == 0, out.stderr[-2000:]
