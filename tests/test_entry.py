"""The entry point with and without the optional operator packages."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"


@pytest.mark.parametrize("leftover", ["nothing", "the pipeline", "an empty folder"])
def test_the_rest_imports_without_the_training_data_operators(tmp_path, leftover):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "curbflow", copy / "curbflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    if leftover == "the pipeline" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", copy)
    if leftover == "an empty folder":
        (copy / "curbflow" / "llm" / "__pycache__").mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100
    assert out[1:] == ["False", "False"]
