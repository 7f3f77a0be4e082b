"""The entry module works with and without the removable part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    copy.mkdir()
    shutil.copytree(os.path.join(ROOT, "kinfold"), copy / "kinfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)


def test_oracles_belong_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
