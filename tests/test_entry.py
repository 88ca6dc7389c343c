import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_stands_alone(tmp_path):
    """Without the text folders and the pipeline the entry still imports."""
    shutil.copytree(ROOT / "fieldloom", tmp_path / "fieldloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def test_nothing_imports_the_text_folder():
    for file in (ROOT / "fieldloom").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"fieldloom[./]llm", file.read_text()), file


def test_every_query_with_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the sample tables")
def test_flagship(spark):
    import __spark_entry__ as e

    made = e.entry(spark)
    assert made.columns == ["event_type", "count", "n_missing", "min", "max", "mean", "std"] and made.count() == 5
