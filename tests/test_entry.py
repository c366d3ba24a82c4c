"""The entry works with and without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_corpus_operators(tmp_path):
    for f in ("__spark_entry__.py", "docloom"):
        (shutil.copytree if (ROOT / f).is_dir() else shutil.copy)(ROOT / f, tmp_path / f)
    shutil.rmtree(tmp_path / "docloom/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'precise' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
