"""The star tables as change envelopes, page logs and dimensions, so that the operators run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from ..schemas import MONEY

DB = "shop"


def text_map(**fields: Column) -> Column:
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))))


def envelope(df: DataFrame, name: str, time: Column, kind: Column | str = "insert", old: Column | None = None, **fields: Column) -> DataFrame:
    """Rows as changes of one logical table."""
    none = F.lit(None).cast("map<string,string>")
    et = F.to_timestamp(time)
    return df.select(F.lit(DB).alias("database"), F.lit(name).alias("table"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.unix_seconds(et).alias("ts"), text_map(**fields).alias("data"), (none if old is None else old).alias("old"), et.alias("et"))


def moment(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def money(c: str) -> Column:
    return F.col(c).cast(MONEY)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return envelope(table(spark, sf, "orders"), "order_info", F.col("o_orderdate"), id=F.col("o_orderkey"), user_id=F.col("o_custkey"), province_id=F.col("o_custkey") % 25, order_status=F.col("o_orderstatus"))


def details(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the order's time as creation time, so that time ranges mean something."""
    return envelope(
        table(spark, sf, "lineitem"), "order_detail", F.col("l_shipdate"), id=line_id(), order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"), sku_name=F.concat(F.lit("sku"), "l_partkey"), create_time=moment("l_shipdate"),
        sku_num=F.col("l_quantity").cast("int"), order_price=money("l_extendedprice"), split_total_amount=money("l_extendedprice"), split_activity_amount=F.lit("0.00"), split_coupon_amount=F.lit(None),
    )


def activities(spark: SparkSession, sf: str) -> DataFrame:
    some = table(spark, sf, "lineitem").where("l_discount > 0.05").groupBy(line_id().alias("id")).agg(F.max("l_suppkey").alias("activity"), F.max("l_shipdate").alias("t"))
    return envelope(some, "order_detail_activity", F.col("t"), order_detail_id=F.col("id"), activity_id=F.col("activity"), activity_rule_id=F.col("activity") % 7)


def coupons(spark: SparkSession, sf: str) -> DataFrame:
    some = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(line_id().alias("id")).agg(F.max("l_linenumber").alias("coupon"), F.max("l_shipdate").alias("t"))
    return envelope(some, "order_detail_coupon", F.col("t"), order_detail_id=F.col("id"), coupon_id=F.col("coupon"))


def order_updates(spark: SparkSession, sf: str, old: str, new: str, status: str) -> DataFrame:
    """Orders of one status as updates from one order status to another, an hour after the order."""
    later = table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
    t = F.col("o_orderdate") + F.expr("interval 1 hour")
    return envelope(later, "order_info", t, "update", text_map(order_status=F.lit(old)), id=F.col("o_orderkey"), user_id=F.col("o_custkey"), province_id=F.col("o_custkey") % 25, order_status=F.lit(new), operate_time=F.date_format(t, "yyyy-MM-dd HH:mm:ss"))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dic_code")).distinct()
    return d.select("dic_code", F.concat(F.lit("name of "), "dic_code").alias("dic_name"))


def flags() -> str:
    return "values ('R', 'returned'), ('A', 'accepted'), ('N', 'none') as t(dic_code, dic_name)"


def page_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as page views: who, which page, where from, how long."""
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("uid"), F.col("event_type").alias("page_id"), F.concat(F.lit("v"), F.col("user_id") % 3).alias("vc"), F.concat(F.lit("ch"), F.col("user_id") % 5).alias("ch"), (F.col("user_id") % 7).cast("string").alias("ar"), (F.col("event_id") % 2).cast("string").alias("is_new"), F.floor("value").cast("long").alias("dur"), (F.col("event_type") == "signup").cast("long").alias("sv"), F.lit(1).cast("long").alias("pv"))
