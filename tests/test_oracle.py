"""Every query against its SQL, as multisets of rows."""

import math
from collections import Counter

import duckdb
import pytest

from rillhouse.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    got = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at, to = [got.columns.index(c) for c in sorted(got.columns)], [want.columns.index(c) for c in sorted(want.columns)]
    a = Counter(tuple(plain(r[i]) for i in at) for r in got.collect())
    b = Counter(tuple(plain(r[i]) for i in to) for r in want.fetchall())
    assert a == b
    assert a or name in ("q2_province_day",)
