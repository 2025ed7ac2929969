"""Schemas of the change envelopes, behaviour logs, configuration, dimensions and result tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L = T.StringType(), T.LongType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def strings(*names: str) -> T.StructType:
    return struct(**dict.fromkeys(names, S))


TEXT_MAP = T.MapType(S, S)
#: Change envelope of the business database; ts in seconds, `old` holds changed fields only.
ENVELOPE = struct(database=S, table=S, type=S, ts=L, data=TEXT_MAP, old=TEXT_MAP)
#: Behaviour log; ts in milliseconds. Parts that are only passed on stay JSON text.
LOG = struct(
    common=strings("mid", "uid", "vc", "ch", "ar", "is_new"),
    page=struct(page_id=S, last_page_id=S, item=S, item_type=S, during_time=L),
    start=S,
    err=S,
    displays=T.ArrayType(S),
    actions=T.ArrayType(S),
    ts=L,
)
#: Page log whose page object is read as a map.
PAGE_LOG = struct(page=TEXT_MAP, ts=L)
DIM_CONFIG = strings("source_table", "sink_table", "sink_columns", "sink_family", "sink_row_key", "op")
DWD_CONFIG = strings("source_table", "source_type", "sink_table", "sink_columns", "op")


def config_change(config: T.StructType) -> T.StructType:
    """Change of a configuration row: op is r, c, u or d."""
    return struct(op=S, before=config, after=config)


ORDER_DETAIL = T.StructType(
    [*strings("id", "order_id", "user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id", "date_id", "create_time", "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount").fields, T.StructField("ts", L)]
)
EMP = struct(empno=T.IntegerType(), ename=S, deptno=T.IntegerType(), ts=L)
DEPT = struct(deptno=T.IntegerType(), deptname=S, ts=L)
MONEY = T.DecimalType(16, 2)
