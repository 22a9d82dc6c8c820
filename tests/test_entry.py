import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from deltascape.plans import queries as engine

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert set(engine.ORACLES) == set(engine.QUERIES) and len(engine.QUERIES) >= 90


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_optional_part(tmp_path):
    """Without the llm folder and the pipeline the rest still imports."""
    for name in ("deltascape", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "deltascape/llm")], check=True)
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert e.oracle_sql().keys() == e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
