"""Sums that outgrow a long."""

import datetime

from pyspark.sql import types as T

from rillhouse.plans import registry


def split(spark, folder, n):
    t = datetime.datetime(9999, 1, 1, tzinfo=datetime.timezone.utc)
    spark.range(n).selectExpr("id AS event_id", f"timestamp '{t:%Y-%m-%d %H:%M:%S}' AS ts", "id AS user_id", "'click' AS event_type", "1.5D AS value", "'{}' AS props").write.parquet(f"{folder}/events.parquet")
    out = registry.QUERIES["p16_log_split"](spark, str(folder))
    return out.schema["ms"].dataType, {r["branch"]: (r["n"], r["ms"]) for r in out.collect()}, int(t.timestamp()) * 1000


def test_log_split_sums_beyond_a_long(spark, tmp_path):
    kind, got, ms = split(spark, tmp_path / "many", 20_000)
    assert 40_000 * ms >= 2**63 and kind == T.DecimalType(38, 0)
    assert got == {"page": (20_000, 20_000 * ms), "display": (40_000, 40_000 * ms), "action": (20_000, 20_000 * ms)}
    kind, got, ms = split(spark, tmp_path / "few", 3)
    assert kind == T.LongType() and got == {"page": (3, 3 * ms), "display": (6, 6 * ms), "action": (3, 3 * ms)}
