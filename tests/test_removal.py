"""Without the removable part the rest imports and runs."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = """
import __spark_entry__ as e
q = e.queries()
assert q and "pipeline" not in q and not [k for k in q if k[:2] == "op" and k[2].isdigit()], sorted(q)
assert set(e.oracle_sql()) <= set(q)
from siltstone.session import session
spark = session("removed", spark__master="local[2]", spark__ui__enabled="false")
print("ROWS", q["trial_audit"](spark, "/root/testdata/sf0.001").count())
"""


def test_rest_runs_without_the_training_operators(tmp_path):
    ignore = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    for with_pipeline in (True, False):
        copy = tmp_path / str(with_pipeline)
        shutil.copytree(ROOT, copy, ignore=ignore)
        if not with_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        ran = subprocess.run([sys.executable, "-c", PROGRAM], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
        assert "ROWS" in ran.stdout, ran.stderr[-2000:]
