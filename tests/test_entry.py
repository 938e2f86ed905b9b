"""The library must work where the training-data folders are not installed."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from driftpool.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = """
import json, __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_folders(tmp_path, pipeline):
    gone = {os.path.join(ROOT, "driftpool", "llm"), os.path.join(ROOT, "tests", "llm")}
    if not pipeline:
        gone.add(os.path.join(ROOT, "corpus_pipeline.py"))

    def skip(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in gone]

    tree = tmp_path / "repo"
    shutil.copytree(ROOT, tree, ignore=skip)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tree, capture_output=True, text=True,
                          timeout=120, env={**os.environ, "PYTHONPATH": str(tree)})
    assert done.returncode == 0, done.stderr[-2000:]
    queries, oracles = json.loads(done.stdout.splitlines()[-1])
    registry.load_all()
    assert queries == sorted(registry.QUERIES) and oracles == sorted(registry.ORACLES)
