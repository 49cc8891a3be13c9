"""The entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("traceloom/llm",), ("corpus_pipeline.py",), ("traceloom/llm", "corpus_pipeline.py")])
def test_queries_without_optional_parts(tmp_path, gone):
    skip = {os.path.join(ROOT, g) for g in gone} | {os.path.join(ROOT, ".git")}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: [n for n in names if os.path.join(d, n) in skip or n == "__pycache__"])
    (tmp_path / "copy/traceloom/llm").mkdir(exist_ok=True)  # what a deleted folder may leave
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(q.startswith('op') for q in e.queries() if q[2:3].isdigit()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    n, pipeline, numbered = out.stdout.split()
    assert int(n) >= 30 and pipeline == "False" and (numbered == "True") == ("traceloom/llm" not in gone and os.path.isdir(os.path.join(ROOT, "traceloom/llm")))
