"""The engine without the corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("leftover", [False, True])
def test_the_rest_imports_without_the_corpus_operators(tmp_path, leftover):  # noqa: ANN001
    shutil.copytree(ROOT / "quaylens", tmp_path / "quaylens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if leftover:  # compiled files of a package that is gone
        (tmp_path / "quaylens" / "llm" / "__pycache__").mkdir(parents=True)
        (tmp_path / "quaylens" / "llm" / "__pycache__" / "queries.cpython-313.pyc").write_bytes(b"")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "quaylens").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quaylens.llm" not in path.read_text(encoding="utf-8"), path
