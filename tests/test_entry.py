"""The entry module works without the optional subpackage and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "dict_lookup" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(e.oracle_sql()) <= names
print("fine")
"""


def test_entry_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "repo"
    gone = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, copy, ignore=gone)
    assert not (copy / "lexiflow" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    out = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr


def test_nothing_else_imports_the_optional_subpackage():
    for f in (ROOT / "lexiflow").rglob("*.py"):
        if "llm" not in f.parts:
            assert "lexiflow.llm" not in f.read_text(encoding="utf-8"), f
