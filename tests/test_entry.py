"""The driver contract with and without the training-data folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names_in(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_stands_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    assert (copy / "corpus_pipeline.py").exists() or not (ROOT / "corpus_pipeline.py").exists()
    without = names_in(copy)
    assert "e1_retrieve_top5" in without and not any(n.startswith("op") or n == "pipeline" for n in without)
    assert set(without) <= set(names_in(ROOT))
