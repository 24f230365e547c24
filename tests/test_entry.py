"""The library stands without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_text_operators(tmp_path, with_pipeline):
    repo = tmp_path / "repo"
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *(() if with_pipeline else ("corpus_pipeline.py",)))
    shutil.copytree(ROOT, repo, ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_reconcile' in q and not any(not n.startswith('q_') for n in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True, timeout=120)
    found = subprocess.run(
        [sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=repo, timeout=300, capture_output=True, text=True
    )
    assert found.returncode == 0, found.stdout[-2000:]
