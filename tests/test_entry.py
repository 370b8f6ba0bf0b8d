"""The driver's contract, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_without_llm(tmp_path):
    shutil.copytree(ROOT / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for path in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lodestone.llm" not in path.read_text()
