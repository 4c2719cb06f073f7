import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and max(r.score for r in rows) == 1.0


def test_the_rest_stands_without_the_text_operators(tmp_path):
    for name in ("larkspur", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_text_operators():
    others = [p for p in (ROOT / "larkspur").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in others if "larkspur.llm" in p.read_text()]
