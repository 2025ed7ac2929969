"""Queries in a new application whose executors are processes of their own."""

import os
import subprocess
import sys
from collections import Counter

import duckdb

from rillhouse.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
from pyspark.sql import SparkSession
from rillhouse.plans import registry

name, sf, out = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
registry.QUERIES[name](spark, sf).write.parquet(out)
"""


def equals_sql(name, sf, out):
    done = subprocess.run([sys.executable, "-c", RUN, name, sf, out], env=os.environ | {"PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    want = con.sql(registry.SQL[name])
    got = con.sql(f"select {', '.join(want.columns)} from '{out}/*.parquet'")
    assert got.types == want.types
    got, want = Counter(got.fetchall()), Counter(want.fetchall())
    assert got == want and got


def test_first_per_day_finds_its_state(sf, tmp_path):
    equals_sql("w5_state_first_per_day", sf, str(tmp_path / "out"))


def test_returning_users_find_their_state(sf, tmp_path):
    equals_sql("w9_state_returning", sf, str(tmp_path / "out"))
