"""The entry works without the training-data operators, and names every query."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_without_llm(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "kindred", tmp_path / "kindred", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, m = map(int, out.stdout.split())
    assert n >= 70 and m >= 70


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
