"""Every query of the engine's own operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from bookloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.5f}"
    return str(value)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    if name not in registry.ORACLE:
        return
    rel = db.sql(registry.ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(row[k]) for k in at) for row in rel.fetchall())


def test_plans_without_python(spark):
    """Queries of built-in operators must not leave the JVM."""
    for name in ("page_quality_metrics", "dict_word_ratio", "running_headers", "gap_timeline", "word_error_rate"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan, name
