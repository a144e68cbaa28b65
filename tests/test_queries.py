"""Every registered query with SQL gives the same rows in an independent engine."""

import math
import os
from datetime import datetime
from decimal import Decimal

import pytest

from quern.plans import registry

SF = os.environ.get("QUERIES_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value) + 0.0:.6g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value.isoformat() if isinstance(value, datetime) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, engine, name):
    got = QUERIES[name](spark, SF)
    want = engine.sql(SQL[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows_without_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    assert QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()
