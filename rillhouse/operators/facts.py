"""Fact tables from change envelopes: inner, left, interval and lookup joins.

Every function takes bounded or streaming envelopes (database, table, type, ts in seconds, data, old, et). A stream
needs bounds to forget by, so `within` adds a time range to the equi joins; a batch leaves it None and joins all.
Amounts are decimals inside and strings in the result, like the topics they go to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MONEY
from .enrich import decode
from .etl import became, cart_additions, fields, moved, rows_of

#: Joins that give each left row by itself.
LEFT_ONCE = ("left", "leftouter", "semi", "leftsemi", "anti", "leftanti")
AMOUNTS = ("split_activity_amount", "split_coupon_amount", "split_total_amount")


def near(a: str, b: str, within: str | None) -> Column:
    """a lies within the interval around b."""
    return F.lit(True) if within is None else F.expr(f"{a} between {b} - interval {within} and {b} + interval {within}")


def in_interval(left: DataFrame, right: DataFrame, on: str, time: str, other: str, early: str, late: str, how: str = "inner", slots: bool = True) -> DataFrame:
    """Rows of both sides that fulfil `on`, `time` of the right side within [other - early, other + late] of the left.

    A batch also joins by slots of time as long as the interval, so that rows of a frequent key meet only those near
    them: a right row has one slot and a left row those of its interval; where unmatched left rows count (or each left
    row once) it is the other way round. A stream's watermark bounds what a row meets, and a full join meets all. Without
    `slots`, for keys with a few rows each, nothing is dealt out anew by slot; the result is the same.
    """
    within = f"({on}) and {time} >= {other} - interval {early} and {time} <= {other} + interval {late}"
    kind = how.lower().replace("_", "")
    if not slots or left.isStreaming or right.isStreaming or kind not in ("inner", *LEFT_ONCE, "right", "rightouter"):
        return left.join(right, F.expr(within), how)
    us = lambda t: f"unix_micros(cast({t} as timestamp))"
    zero = "timestamp_seconds(0)"
    size = f"greatest({us(f'{zero} + interval {late}')} - {us(f'{zero} - interval {early}')}, 1)"
    slot = lambda t: f"{us(t)} div {size}"
    one, many = "_slot_one", "_slot_many"
    if kind in LEFT_ONCE:  # one slot more at both ends: months and days have no fixed length
        left = left.withColumn(one, F.expr(slot(other)))
        right = right.withColumn(many, F.expr(f"explode(sequence({slot(f'{time} - interval {late}')} - 1, {slot(f'{time} + interval {early}')} + 1))"))
    else:
        right = right.withColumn(one, F.expr(slot(time)))
        left = left.withColumn(many, F.expr(f"explode(sequence({slot(f'{other} - interval {early}')}, {slot(f'{other} + interval {late}')}))"))
    return left.join(right, F.expr(f"{one} = {many} and {within}"), how).drop(one, many)


def relate(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """A regular join; rows without a partner by `on` have nulls on the other side, as `how` says."""
    return left.join(right, F.expr(on), how)


def day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def order_detail(db: DataFrame, source_db: str | None = None, within: str | None = None) -> DataFrame:
    """Order lines with their order (inner), activity and coupon (left)."""
    d = fields(rows_of(db, "order_detail", source_db=source_db), "id", "order_id", "sku_id", "sku_name", "create_time", "sku_num", "order_price", *AMOUNTS, more=("ts", "et"))
    original = (F.col("sku_num").try_cast(MONEY) * F.col("order_price").try_cast(MONEY)).cast("string")
    d = d.withColumn("split_original_amount", original).alias("d")
    o = fields(rows_of(db, "order_info", source_db=source_db), more=("et",), o_id="id", user_id="user_id", province_id="province_id").alias("o")
    a = fields(rows_of(db, "order_detail_activity", source_db=source_db), "activity_id", "activity_rule_id", more=("et",), a_id="order_detail_id").alias("a")
    c = fields(rows_of(db, "order_detail_coupon", source_db=source_db), "coupon_id", more=("et",), c_id="order_detail_id").alias("c")
    out = d.join(o, (F.col("order_id") == F.col("o_id")) & near("o.et", "d.et", within))
    out = out.join(a, (F.col("id") == F.col("a_id")) & near("a.et", "d.et", within), "left").join(c, (F.col("id") == F.col("c_id")) & near("c.et", "d.et", within), "left")
    return out.select("id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id", day("create_time").alias("date_id"), "create_time", "sku_num", "split_original_amount", *AMOUNTS, "ts", F.col("d.et").alias("et"))


def order_cancel(detail: DataFrame, db: DataFrame, how: str = "inner", within: str | None = None) -> DataFrame:
    """Order lines of cancelled orders (status 1001 to 1003); how='left' keeps every line."""
    c = fields(moved(db.where(F.col("table") == "order_info"), "order_status", "1001", "1003"), more=("et", "ts"), c_id="id", cancel_time="operate_time").withColumnRenamed("ts", "c_ts").alias("c")
    d = detail.alias("d")
    out = d.join(c, (F.col("order_id") == F.col("c_id")) & near("c.et", "d.et", within), how)
    keep = [x for x in detail.columns if x not in ("date_id", "create_time", "ts", "et")]
    return out.select(*keep, day("cancel_time").alias("date_id"), "cancel_time", F.coalesce("c_ts", "d.ts").alias("ts"))


def payment_success(detail: DataFrame, db: DataFrame, dic: DataFrame, early: str = "30 minutes", late: str = "5 seconds", source_db: str | None = None) -> DataFrame:
    """Payments (status 1602) with the order lines of the interval before them, and the payment type's name."""
    p = rows_of(db, "payment_info", ("update",), source_db)
    p = fields(became(p, "payment_status", "1602"), more=("ts", "et"), p_order="order_id", p_user="user_id", payment_type_code="payment_type", callback_time="callback_time")
    p = p.withColumnsRenamed({"ts": "p_ts", "et": "p_et"})
    d = detail.withColumnRenamed("et", "d_et")
    out = decode(in_interval(p, d, "order_id = p_order", "d_et", "p_et", early, late, slots=False), dic, "payment_type_code", "payment_type_name")
    return out.select(F.col("id").alias("order_detail_id"), "order_id", F.coalesce("user_id", "p_user").alias("user_id"), "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id", "payment_type_code", "payment_type_name", "callback_time", "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount", F.col("split_total_amount").alias("split_payment_amount"), F.col("p_ts").alias("ts"))


def order_refund(db: DataFrame, dic: DataFrame, source_db: str | None = None, within: str | None = None) -> DataFrame:
    """Refund requests with their order (status 1005), type and reason; one dictionary looked up twice."""
    r = fields(rows_of(db, "order_refund_info", source_db=source_db), "id", "user_id", "order_id", "sku_id", "refund_num", "refund_amount", "refund_reason_txt", "create_time", more=("ts", "et"), refund_type_code="refund_type", refund_reason_type_code="refund_reason_type").alias("r")
    o = fields(became(rows_of(db, "order_info", ("update",), source_db), "order_status", "1005"), "province_id", more=("et",), o_id="id").alias("o")
    out = r.join(o, (F.col("order_id") == F.col("o_id")) & near("o.et", "r.et", within))
    out = decode(decode(out, dic, "refund_type_code", "refund_type_name"), dic, "refund_reason_type_code", "refund_reason_type_name")
    return out.select("id", "user_id", "order_id", "sku_id", "province_id", day("create_time").alias("date_id"), "create_time", "refund_type_code", "refund_type_name", "refund_reason_type_code", "refund_reason_type_name", "refund_reason_txt", "refund_num", "refund_amount", "ts")


def refund_payment_success(db: DataFrame, dic: DataFrame, source_db: str | None = None, within: str | None = None) -> DataFrame:
    """Paid refunds with their request (by order and sku), order (status 1006) and payment type."""
    p = fields(became(rows_of(db, "refund_payment", ("update",), source_db), "refund_status", "1602"), "id", "order_id", "sku_id", "callback_time", more=("ts", "et"), payment_type_code="payment_type", refund_amount="total_amount").alias("p")
    r = fields(became(rows_of(db, "order_refund_info", ("update",), source_db), "refund_status", "0705"), "refund_num", more=("et",), r_order="order_id", r_sku="sku_id").alias("r")
    o = fields(became(rows_of(db, "order_info", ("update",), source_db), "order_status", "1006"), "user_id", "province_id", more=("et",), o_id="id").alias("o")
    out = p.join(r, (F.col("order_id") == F.col("r_order")) & (F.col("sku_id") == F.col("r_sku")) & near("r.et", "p.et", within))
    out = decode(out.join(o, (F.col("order_id") == F.col("o_id")) & near("o.et", "p.et", within)), dic, "payment_type_code", "payment_type_name")
    return out.select("id", "user_id", "order_id", "sku_id", "province_id", "payment_type_code", "payment_type_name", day("callback_time").alias("date_id"), "callback_time", "refund_num", "refund_amount", "ts")


def cart_add(db: DataFrame) -> DataFrame:
    return cart_additions(db)


def comment_info(db: DataFrame, dic: DataFrame, source_db: str | None = None) -> DataFrame:
    """Comments with the name of their appraisal."""
    c = fields(rows_of(db, "comment_info", source_db=source_db), "id", "user_id", "sku_id", "appraise", "comment_txt")
    return decode(c, dic, "appraise", "appraise_name").select("id", "user_id", "sku_id", "appraise", "appraise_name", "comment_txt", "ts")
