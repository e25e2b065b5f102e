"""The rest of the repository without the text operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
names = list(e.queries())
assert names and not [n for n in names if n == "pipeline" or n.startswith("op1_")]
assert set(e.oracle_sql()) <= set(names)
import bench, graphloom.cli, graphloom.engine
"""


def test_without_text_operators(tmp_path):
    skipped = shutil.ignore_patterns("llm", "__pycache__", ".git", "spark-warehouse", ".pytest_cache")
    for pipeline in (True, False):
        to = tmp_path / str(pipeline)
        shutil.copytree(HERE, to, ignore=skipped)
        if not pipeline:
            (to / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-B", "-c", SCRIPT], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
