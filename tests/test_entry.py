"""The driver's contract with and without the optional operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q), set(o) <= set(q))"


def counted(folder):
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()[-4:]


@pytest.mark.parametrize("left_over", [False, True])
def test_without_the_optional_operators(tmp_path, left_over):
    """Also where a folder with compiled files stays behind."""
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py")
    shutil.copytree(TOP, tmp_path / "repo", ignore=skip)
    if left_over:
        (tmp_path / "repo/newsflow/llm/__pycache__").mkdir(parents=True)
    n, pipeline, numbered, oracles = counted(tmp_path / "repo")
    assert int(n) > 80 and (pipeline, numbered, oracles) == ("False", "False", "True")


def test_pipeline_without_its_operators(tmp_path):
    shutil.copytree(TOP, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    assert counted(tmp_path / "repo")[1:] == ["False", "False", "True"]
