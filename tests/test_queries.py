"""Every registered query of the run operators against its SQL oracle, on the smallest tables."""

import math
import os

import duckdb
import pytest

from callscope.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr([plain(v) for v in value]) if isinstance(value, list | tuple) else repr(value)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, con, name):
    got = registry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    names = want.columns
    assert sorted(names) == columns
    assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in want.fetchall())
