import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from anamnesis.plans import catalog

DIR = "/root/testdata/sf0.001"


def canonical(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, float):
        return str(int(v)) if np.isfinite(v) and v == int(v) else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(canonical, r)) for r in df.select(columns).collect())
    if name in catalog.ORACLES:
        found = tables.sql(catalog.ORACLES[name])
        assert sorted(found.columns) == columns
        assert rows == sorted(tuple(canonical(r[found.columns.index(c)]) for c in columns) for r in found.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rk", "id", "similarity", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_search_plan(spark):
    """Only the best of each block of memories reach the window, which cuts again before it shuffles."""
    plan = catalog.QUERIES["dense_search"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan


def test_without_corpus_operators(tmp_path):
    """The rest of the library works where the subpackage for training data is missing."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/anamnesis", tmp_path / "anamnesis", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dense_search' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
