import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from linemill import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(own.SQL[name]).df(), entry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).values.tolist()))
    assert rows(want) == rows(got)


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 3


def test_imports_without_training_data(tmp_path):
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root / "linemill", tmp_path / "linemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'file_stats' in e.queries() and not any(n.startswith('op') for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=60)
