"""The driver's contract, with and without the optional subpackage."""

import os
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["precision", "recall"]
    assert df.count() > 0


def test_nothing_else_needs_llm(tmp_path):
    """The library and the entry module import where the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "voxloom", tmp_path / "voxloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    for p in (ROOT / "voxloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"voxloom\.llm|from voxloom import llm", p.read_text()), p


def test_no_local_checkpoint():
    for p in [*(ROOT / "voxloom").rglob("*.py"), ROOT / "__spark_entry__.py"]:
        assert "localCheckpoint" not in p.read_text(), p
