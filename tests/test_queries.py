"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from tagloom.plans import mining, retrieval, tables  # noqa: F401
from tagloom.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return "" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    answer = sql.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert got == wanted


def test_entry_without_the_optional_part(tmp_path):
    """The registry works where the optional subpackage and pipeline are gone."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tagloom", tmp_path / "tagloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kg_search' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
