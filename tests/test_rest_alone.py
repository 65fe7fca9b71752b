"""The rest of the library stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_llm(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ret1_bm25' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
    assert int(done.stdout.split()[-1]) > 140
    some = ["tests/test_operators.py", "-k", "truth_table or implied_bounds or area_round_trip", "-x", "-q", "-p", "no:cacheprovider"]
    done = subprocess.run([sys.executable, "-m", "pytest", *some], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True)
    assert done.returncode == 0 and "3 passed" in done.stdout, done.stdout[-800:]
