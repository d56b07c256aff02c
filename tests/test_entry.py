import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert entry.entry(spark).count() > 0


def test_imports_without_a_session():
    root = Path(entry.__file__).parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=60)
    assert out.stdout.strip() == "True", out.stderr
