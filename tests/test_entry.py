"""The entry module without the text operators, as in an installation that leaves them out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_text_operators(tmp_path, also):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *also))
    code = "import __spark_entry__ as e; print(len(e.queries()), sum('op' == n[:2] for n in e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    total, ours = map(int, run.stdout.split())
    assert total > 80 and ours == 0
