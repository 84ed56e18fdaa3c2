import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(__file__).parent.parent


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, pipeline):
    for p in ROOT.iterdir():
        if p.name not in (".git", "brindle", "tests") and (pipeline or p.name != "corpus_pipeline.py"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "brindle").mkdir()
    for p in (ROOT / "brindle").iterdir():
        if p.name != "llm":
            (tmp_path / "brindle" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    n, m, more = said.stdout.split()
    assert int(n) == int(m) >= 60 and more == "False", said.stderr


def test_nothing_else_imports_them():
    for p in (ROOT / "brindle").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "brindle.llm" not in p.read_text(), p
