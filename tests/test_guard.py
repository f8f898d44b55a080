"""The library works without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

from conftest import ROOT


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "tideline", tmp_path / "tideline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kv_latest_state' in q and not any(x.startswith('op') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)


def test_an_error_inside_the_subpackage_is_an_error(tmp_path):
    shutil.copytree(ROOT / "tideline", tmp_path / "tideline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tideline" / "llm").mkdir()
    (tmp_path / "tideline" / "llm" / "queries.py").write_text("import no_such_package")
    (tmp_path / "corpus_pipeline.py").write_text("")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.returncode and "no_such_package" in done.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "tideline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text())
