"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from textveil.plans.catalogue import QUERIES, SQL

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{TABLES}/{name}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, TABLES)
    assert sorted(got.columns) == sorted(columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect())
    assert rows and rows == Counter(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_filter_reaches_the_scan(spark):
    plan = spark.read.parquet(f"{TABLES}/documents.parquet").where("lang = 'en'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "text" not in plan.split("ReadSchema")[1]
