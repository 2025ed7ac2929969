"""Tumbling event-time windows with the bounds as strings, as the result tables carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumble(df: DataFrame, time: str, *aggs: Column, keys: tuple[str, ...] = (), size: str = "10 seconds") -> DataFrame:
    """stt, edt, cur_date, keys and aggregates of each window [start, end); aggregation is partial before the shuffle."""
    out = df.groupBy(F.window(time, size).alias("w"), *keys).agg(*aggs)
    rest = [c for c in out.columns if c not in ("w", *keys)]
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select(fmt("w.start").alias("stt"), fmt("w.end").alias("edt"), F.date_format("w.start", "yyyy-MM-dd").alias("cur_date"), *keys, *rest)


def total(c: str) -> Column:
    return F.sum(F.coalesce(c, F.lit(0))).alias(c)


def page_views(df: DataFrame, time: str = "et", size: str = "10 seconds") -> DataFrame:
    """Views, visitors, sessions and duration by version, channel, area and new-visitor flag (uv, sv, pv, dur per row)."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(n) for c, n in (("uv", "uv_ct"), ("sv", "sv_ct"), ("pv", "pv_ct"), ("dur", "dur_sum"))]
    return tumble(df, time, *sums, keys=("vc", "ch", "ar", "is_new"), size=size)


def home_detail(df: DataFrame, time: str = "et", size: str = "10 seconds") -> DataFrame:
    return tumble(df, time, F.sum("home_uv").cast("long").alias("home_uv_ct"), F.sum("detail_uv").cast("long").alias("good_detail_uv_ct"), size=size)


def logins(df: DataFrame, time: str = "et", size: str = "10 seconds") -> DataFrame:
    return tumble(df, time, F.sum("back").cast("long").alias("back_ct"), F.sum("uu").cast("long").alias("uu_ct"), size=size)


def cart_users(df: DataFrame, time: str = "et", size: str = "10 seconds") -> DataFrame:
    return tumble(df, time, F.count(F.lit(1)).alias("cart_add_uu_ct"), size=size)


def keywords(df: DataFrame, time: str = "et", size: str = "10 seconds") -> DataFrame:
    return tumble(df, time, F.count(F.lit(1)).alias("keyword_count"), keys=("keyword",), size=size)


SKU_AMOUNTS = ("original_amount", "activity_reduce_amount", "coupon_reduce_amount", "order_amount")


def sku_orders(df: DataFrame, time: str = "et", size: str = "10 seconds") -> DataFrame:
    return tumble(df, time, *(total(c) for c in SKU_AMOUNTS), keys=("sku_id",), size=size)


def province_orders(df: DataFrame, time: str = "et", size: str = "10 seconds", streaming: bool = False) -> DataFrame:
    """Exact number of different orders and amount by province; a stream collects the orders of an open window."""
    n = F.size(F.collect_set("order_id")).cast("long") if streaming else F.countDistinct("order_id")
    return tumble(df, time, n.alias("order_count"), total("order_amount"), keys=("province_id",), size=size)
