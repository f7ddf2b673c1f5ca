"""Every query of the entry against its SQL, over the smallest tables."""

import decimal
import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from evenkeel import queries as _base

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TOP = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(_base.oracle_sql()))
def test_query(spark, con, small, name):
    got = entry.queries()[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    want = con.sql(entry.oracle_sql()[name])
    have = sorted(want.columns)
    assert columns == have
    at = [want.columns.index(c) for c in have]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_registered():
    assert set(_base.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_only_distinct_keys_are_hashed(spark, small):
    """The scan's filter holds no hash: partition sizes take it of distinct keys, after the aggregation."""
    plan = _base.fnv_partition_sizes(spark, small)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in scan and "conv(" not in scan


def test_isolation_numbers_no_rows(spark, small):
    """Its heavy keys are joined without salts, so no row is looked up for its occurrence; the salted join does that."""
    plan = lambda q: q(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in plan(_base.salted_join) and "__block" not in plan(_base.isolation_join)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_library_stands_without_the_corpus_operators(tmp_path):
    """With llm and the pipeline gone, the entry imports and has the other queries."""
    import shutil

    shutil.copytree(TOP / "evenkeel", tmp_path / "evenkeel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'salted_join' in n and not [x for x in n if x.startswith('op')] and 'pipeline' not in n and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": __import__("os").environ["PATH"], "PYTHONPATH": str(tmp_path)})
    for f in (TOP / "evenkeel").rglob("*.py"):
        if "llm" not in f.parts:
            assert ".llm" not in f.read_text(), f
    importlib.import_module("evenkeel.queries")
