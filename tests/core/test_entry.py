"""The entry point without the training-data folders."""

import os
import shutil
import subprocess
import sys

from ..conftest import ROOT

SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"


def test_entry_imports_without_the_training_data_folders(tmp_path):
    for keep_pipeline in (True, False):
        copy = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "tests", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) >= 41 and out[1] == "False"
