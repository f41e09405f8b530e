"""The driver's contract, with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "veridex", tmp_path / "veridex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ece' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_outside_uses_the_optional_part():
    for p in (ROOT / "veridex").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "veridex.llm" not in p.read_text(), p
