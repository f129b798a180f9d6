"""The rest stands without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_entry_imports_without_the_corpus_operators(tmp_path, pipeline):
    for name in ("onset", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(ROOT / name, tmp_path)
    said = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q); assert e.oracle_sql().keys() <= q.keys(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    from onset.plans.queries import QUERIES

    assert int(done.stdout) == len(QUERIES)
    outside = [f for f in (ROOT / "onset").rglob("*.py") if "llm" not in f.parts and "onset.llm" in f.read_text()]
    assert outside == []
