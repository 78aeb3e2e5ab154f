"""Every registered query of the engine against its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quillstream.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for name in os.listdir(DIR):
        con.sql(f"create view {name[:-8]} as select * from '{DIR}/{name}'")
    return con


def plain(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows or name in ("mcq_filter", "missing_store")
    if name in registry.SQL:
        result = duck.execute(registry.SQL[name])
        names = [x[0] for x in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
