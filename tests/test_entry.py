import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    assert E.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_without_the_text_operators(tmp_path):
    """The rest imports and registers its queries when the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'activity_stats' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
