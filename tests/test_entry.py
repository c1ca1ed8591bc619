import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).parent.parent


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_nothing_else_needs_llm(tmp_path):
    """Without corpus_pipeline.py and the llm folder the entry still imports, with the other queries."""
    for name in ("quire", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(REPO / name)
    (tmp_path / "quire").unlink()
    (tmp_path / "quire").mkdir()
    for p in (REPO / "quire").iterdir():
        if p.name != "llm":
            (tmp_path / "quire" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'audit_with_solution' in q and 'op7_quality_rules' not in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
