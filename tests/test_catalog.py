"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from lakewright.plans.catalog import ORACLE_SQL, QUERIES

from .compare import database, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name in ORACLE_SQL:
        found = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark):
    from lakewright.operators import index

    df = index.top(spark.read.parquet(f"{FOLDER}/part.parquet").selectExpr("p_name AS name", "p_type AS summary", "p_size AS downloads"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(p_size,0)" in plan
    assert "p_retailprice" not in plan
