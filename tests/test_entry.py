"""The entry without the subpackage that may be taken out."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; print('NAMES', *e.queries(), '|', *e.oracle_sql())"


def names(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return said.stdout.split("NAMES ")[1].split("|")[0].split()


def test_entry_without_llm(tmp_path):
    """With the folders deleted, and the pipeline there or not, all other queries are named."""
    for name in ("textveil", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "textveil" / "llm", ignore_errors=True)
    rest = names(tmp_path)
    assert rest and not [n for n in rest if n.startswith("op") or n == "pipeline"]
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path) == rest


def test_nothing_else_imports_llm():
    for path in (ROOT / "textveil").rglob("*.py"):
        if "llm" not in path.parts:
            assert "textveil.llm" not in path.read_text(), path
