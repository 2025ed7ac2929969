"""Returning users by keyed state over events with odd times."""

import datetime
from collections import Counter

import duckdb
import pytest

from rillhouse.plans import registry


@pytest.mark.parametrize("times", [(None, None), ("2024-01-01", None, None, "2024-01-03", "2024-01-04"), ("0900-05-06", "0900-05-08", "0900-05-08"), ("1969-12-31", "1970-01-01")])
def test_returning_users_equal_the_sql(spark, tmp_path, times):
    at = [t and datetime.datetime.fromisoformat(f"{t}T23:59:59.999") for t in times]
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint)")
    con.executemany("insert into events values (?, ?, ?)", [(2 * k + u, t, 7 if u else None) for k, t in enumerate(at) for u in (0, 1)])
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    want = con.sql(registry.SQL["w9_state_returning"])
    got = registry.QUERIES["w9_state_returning"](spark, str(tmp_path)).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
