"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() == 12 and "class" in rows.columns


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_part(tmp_path):
    shutil.copytree(REPO / "glyphsieve", tmp_path / "glyphsieve", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False"
