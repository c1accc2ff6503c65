import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_stands_without_the_corpus_operators(tmp_path):
    """A copy without the subpackage and the pipeline imports and keeps the graph queries."""
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ag9_modularity' in q and 'pipeline' not in q and not [n for n in q if n[:2] == 'op']"
    (tmp_path / "plexor").mkdir()
    for p in (ROOT / "plexor").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "plexor" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
