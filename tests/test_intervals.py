"""Interval joins: every kind against single comparisons, and a frequent key."""

import threading

import pytest
from pyspark.sql import functions as F

from rillhouse.operators import facts

TIMES = (None, -40_000, -10_001, -1, 0, 3, 5, 10, 11, 20_000, 20_001, 60_000, 86_400_000)


@pytest.fixture(scope="module")
def sides(spark):
    rows = [(k, t) for k in ("x", "y", None) for t in TIMES] + [("x", 5), ("z", 0)]
    make = lambda k, t, more: spark.createDataFrame([*rows, *more], f"{k} string, {t} long").withColumn(t, F.timestamp_millis(t))
    return make("a", "at", [("left", 1)]), make("b", "bt", [("right", 1)])


@pytest.mark.parametrize("how", ["inner", "left", "left_outer", "right", "rightouter", "full", "semi", "left_semi", "anti", "leftanti"])
@pytest.mark.parametrize(("early", "late"), [("5 milliseconds", "5 milliseconds"), ("10 seconds", "0 seconds"), ("0 seconds", "0 seconds"), ("1 month", "1 day"), ("-3 milliseconds", "10 milliseconds"), ("5 milliseconds", "-6 milliseconds")])
def test_interval_joins(sides, how, early, late):
    a, b = sides
    got = facts.in_interval(a, b, "a = b", "bt", "at", early, late, how)
    want = a.join(b, F.expr(f"a = b and bt >= at - interval {early} and bt <= at + interval {late}"), how)
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_aliases_stay(sides):
    a, b = sides[0].alias("l"), sides[1].alias("r")
    got = facts.in_interval(a, b, "l.a = r.b", "r.bt", "l.at", "5 milliseconds", "5 milliseconds").select("l.at", "r.bt")
    assert got.where("at is null or bt is null").count() == 0 and got.where("l.at = r.bt").count() > 0


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_rows_of_a_frequent_key_meet_only_those_near(spark, how):
    n = 200_000
    side = lambda k, t: spark.range(n).select(F.lit("x").alias(k), F.timestamp_millis("id").alias(t))
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert facts.in_interval(side("a", "at"), side("b", "bt"), "a = b", "bt", "at", "5 milliseconds", "5 milliseconds", how).count() == 11 * n - 30
    finally:
        late.cancel()
