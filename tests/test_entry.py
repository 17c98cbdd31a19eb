import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_engine_stands_without_the_optional_subpackage(tmp_path, with_pipeline):
    for name in ("__spark_entry__.py", "platterlake", "corpus_pipeline.py")[: 3 if with_pipeline else 2]:
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "platterlake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "platterlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "platterlake.llm" not in path.read_text()


def test_flagship(spark):
    if Path("/root/testdata/sf0.001").is_dir():
        assert entry.entry(spark).count() > 0
