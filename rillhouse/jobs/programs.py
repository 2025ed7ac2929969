"""The programs. Each takes (spark, places) and returns its running query, or the HTTP server of the results.

Stream joins forget by time ranges (`within`), keyed state by a time to live, windows by a watermark. Facts with a
primary key go to upsert tables and, as JSON, to their topic; window results are appended by day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas, sources
from ..functions import text
from ..operators import config, enrich, etl, facts, windows
from ..plans import serving
from ..streaming import processors as P
from ..streaming import sinks
from .places import Places

PROGRAMS: dict[str, Callable] = {}
#: Database of the change envelopes, and the topics (fixed names).
DB, CHANGES, LOGS = "gmall", "topic_db", "topic_log"
PAGE, ORDERS, CART = "dwd_traffic_page", "dwd_trade_order_detail", "dwd_trade_cart_add"
#: How long the rows of a join wait for each other.
ORDER_WAIT, CANCEL_WAIT, REFUND_WAIT = "10 seconds", "1805 seconds", "5 seconds"


def program(f: Callable) -> Callable:
    PROGRAMS[f.__name__] = f
    return f


def run(name: str, spark: SparkSession, places: Places):
    return PROGRAMS[name](spark, places)


def changes(spark: SparkSession, places: Places) -> DataFrame:
    return sources.ods_db(places.topic(spark, CHANGES))


def dictionary(spark: SparkSession, places: Places) -> DataFrame:
    return places.dim(spark, "dim_base_dic").select("dic_code", "dic_name")


def settings(spark: SparkSession, places: Places, name: str, kind: T.StructType, *key: str) -> DataFrame:
    """The configuration as its changes leave it; read anew for each batch."""
    lines = sources.topic(spark, places.topic_name(name), places.fmt, False, places.options)
    rows = sources.from_json(lines, T.StructType([*schemas.config_change(kind).fields, T.StructField("ts_ms", T.LongType())]))
    return config.latest(rows.withColumn("ts_ms", F.coalesce("ts_ms", F.lit(0))), "ts_ms", *key)


# ------------------------------------------------------------------ dimensions and routed facts


@program
def dim(spark: SparkSession, places: Places):
    """Changes of configured tables into dimension tables, which the configuration's changes create and drop."""
    root = f"{places.root}/dim"
    sink = sinks.DimSink(root, lambda: settings(spark, places, "table_process_dim", schemas.DIM_CONFIG, "source_table"))

    def write(batch: DataFrame, batch_id: int) -> None:
        for r in sink.config().collect():  # one row a configured table
            names = [*sinks.columns_of(r["sink_columns"]), "_key"]
            kind = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_gone", T.BooleanType()), T.StructField("_ts", T.LongType())])
            sinks.create_table(spark, sink.path(r["sink_table"]), kind)
        sink(batch, batch_id)

    return sinks.each(etl.dim_changes(sources.ods_db(places.topic(spark, CHANGES), None), DB), write, places.checkpoint("dim"), places.trigger)


@program
def dim_tables(spark: SparkSession, places: Places):
    """Configuration changes as they come: tables of new rows appear, of dropped ones go, of changed ones begin anew."""
    rows = sources.config_changes(places.topic(spark, "table_process_dim"), schemas.DIM_CONFIG)
    return sinks.each(rows, lambda batch, _: sinks.apply_config(spark, f"{places.root}/dim", batch), places.checkpoint("dim_tables"), places.trigger)


@program
def dwd_base_db(spark: SparkSession, places: Places):
    """Changes whose table and type are configured, each to the topic it is configured for."""
    rows = etl.live_changes(sources.from_json(places.topic(spark, CHANGES), schemas.ENVELOPE, strict=True))

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = config.route_fact(batch, settings(spark, places, "table_process_dwd", schemas.DWD_CONFIG, "source_table", "source_type"))
        out = routed.select("topic", F.to_json("data").alias("value"))
        if places.fmt == "kafka":
            out.write.format("kafka").options(**places.options).save()
        else:
            out.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "batch").text(f"{places.root}/topic/routed")

    return sinks.each(rows, write, places.checkpoint("dwd_base_db"), places.trigger)


@program
def dwd_base_log(spark: SparkSession, places: Places):
    """Behaviour logs: malformed ones apart, the new-visitor flag repaired, then split to five topics."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = etl.split_parsed(batch)
        for name, part in parts.items():
            target = places.topic_name(f"dwd_traffic_{name}")
            out = part if part.columns == ["value"] else etl.to_record(part)
            if places.fmt == "kafka":
                out.write.format("kafka").options(topic=target, **places.options).save()
            else:
                out.write.mode("overwrite").text(f"{target}/batch={batch_id:012d}")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write(batch, batch_id)
        finally:
            batch.unpersist()

    logs = etl.parsed_log(places.topic(spark, LOGS)).withColumns({"mid": F.coalesce("common.mid", F.lit("")), "is_new": F.col("common.is_new")})
    return sinks.each(etl.with_flag(repaired(logs)), each_batch, places.checkpoint("dwd_base_log"), places.trigger)


def repaired(logs: DataFrame) -> DataFrame:
    """Logs whose new-visitor flag is repaired by keyed state; malformed ones have no visitor and pass."""
    return P.with_state(logs, "mid", P.VisitorRepair(logs.schema), logs.schema, "None")


# ------------------------------------------------------------------ facts


@program
def dwd_interaction_comment_info(spark: SparkSession, places: Places):
    return places.to_topic(facts.comment_info(changes(spark, places), dictionary(spark, places), DB), "dwd_interaction_comment_info", "dwd_interaction_comment_info")


@program
def dwd_trade_cart_add(spark: SparkSession, places: Places):
    return places.to_topic(facts.cart_add(changes(spark, places)), CART, "dwd_trade_cart_add")


@program
def dwd_trade_order_detail(spark: SparkSession, places: Places):
    out = facts.order_detail(changes(spark, places), DB, ORDER_WAIT)
    return places.to_topic(out.drop("et"), ORDERS, "dwd_trade_order_detail")


def order_lines(spark: SparkSession, places: Places, delay: str) -> DataFrame:
    return sources.fact_topic(places.topic(spark, ORDERS), schemas.ORDER_DETAIL, delay)


@program
def dwd_trade_order_cancel_detail(spark: SparkSession, places: Places):
    out = facts.order_cancel(order_lines(spark, places, "3 seconds"), changes(spark, places), within=CANCEL_WAIT)
    return places.to_topic(out, "dwd_trade_order_cancel", "dwd_trade_order_cancel_detail")


@program
def dwd_trade_order_pay_suc_detail(spark: SparkSession, places: Places):
    out = facts.payment_success(order_lines(spark, places, "3 seconds"), changes(spark, places), dictionary(spark, places), source_db=DB)
    return places.to_topic(out, "dwd_trade_order_payment_success", "dwd_trade_order_pay_suc_detail")


@program
def dwd_trade_order_refund(spark: SparkSession, places: Places):
    out = facts.order_refund(changes(spark, places), dictionary(spark, places), DB, REFUND_WAIT)
    return places.to_topic(out, "dwd_trade_order_refund", "dwd_trade_order_refund")


@program
def dwd_trade_refund_pay_suc_detail(spark: SparkSession, places: Places):
    out = facts.refund_payment_success(changes(spark, places), dictionary(spark, places), DB, REFUND_WAIT)
    return places.to_topic(out, "dwd_trade_refund_payment_success", "dwd_trade_refund_pay_suc_detail")


# ------------------------------------------------------------------ windows

VISIT = T.StructType([*schemas.strings("mid", "uid", "vc", "ch", "ar", "is_new", "page_id", "last_page_id").fields, T.StructField("dur", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("et", T.TimestampType())])


def page_visits(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Page logs flat: visitor, version, channel, area, flag, page, the page before, duration, time."""
    page = sources.from_json(df, schemas.struct(common=schemas.LOG["common"].dataType, page=schemas.LOG["page"].dataType, ts=T.LongType()))
    out = page.select("common.*", "page.page_id", "page.last_page_id", F.coalesce("page.during_time", F.lit(0)).alias("dur"), "ts", F.timestamp_millis("ts").alias("et"))
    out = out.select(*(F.col(f.name).cast(f.dataType) for f in VISIT.fields))
    return out.withWatermark("et", delay) if df.isStreaming else out


def flagged(df: DataFrame, key: str, processor, *flags: str) -> DataFrame:
    """Rows with the flags that keyed state gives them; their event time goes on to the windows."""
    return P.with_state(df, key, processor, P.plus(df.schema, *flags), "EventTime", "et")


@program
def dws_traffic_source_keyword_page_view_window(spark: SparkSession, places: Places):
    terms = text.search_terms(sources.page_log(places.topic(spark, PAGE)))
    out = windows.keywords(text.keywords(terms), "et", places.window)
    return places.to_result(out, "dws_traffic_source_keyword_page_view_window", "dws_keyword")


@program
def dws_traffic_vc_ch_ar_is_new_page_view_window(spark: SparkSession, places: Places):
    visits = flagged(page_visits(places.topic(spark, PAGE)), "mid", P.FirstPerDay(ttl_ms=None), "uv")
    rows = visits.withColumns({"pv": F.lit(1), "sv": etl.starts_session(F.col("last_page_id")).cast("long")})
    return places.to_result(windows.page_views(rows, "et", places.window), "dws_traffic_vc_ch_ar_is_new_page_view_window", "dws_page_view")


@program
def dws_traffic_home_detail_page_view_window(spark: SparkSession, places: Places):
    pages = etl.home_and_detail(page_visits(places.topic(spark, PAGE))).withColumn("mid", F.concat_ws("|", "mid", "page_id"))
    first = flagged(pages, "mid", P.FirstPerDay(ttl_ms=None, only_first=True), "uv")
    rows = first.select("et", (F.col("page_id") == "home").cast("long").alias("home_uv"), (F.col("page_id") == "good_detail").cast("long").alias("detail_uv"))
    return places.to_result(windows.home_detail(rows, "et", places.window), "dws_traffic_home_detail_page_view_window", "dws_home_detail")


@program
def dws_user_user_login_window(spark: SparkSession, places: Places):
    users = flagged(etl.logins(page_visits(places.topic(spark, PAGE))), "uid", P.ReturningUser(ttl_ms=None), "uu", "back")
    return places.to_result(windows.logins(users, "et", places.window), "dws_user_user_login_window", "dws_login")


@program
def dws_trade_cart_add_uu_window(spark: SparkSession, places: Places):
    cart = sources.fact_topic(places.topic(spark, CART), schemas.struct(user_id=T.StringType(), ts=T.LongType()), "0 seconds")
    # time in milliseconds for the processor, as the page logs have it
    users = flagged(cart.withColumn("ts", F.col("ts") * 1000), "user_id", P.FirstPerDay(ttl_ms=None, only_first=True), "uv")
    return places.to_result(windows.cart_users(users, "et", places.window), "dws_trade_cart_add_uu_window", "dws_cart")


LINE_AMOUNTS = {"original_amount": "split_original_amount", "activity_reduce_amount": "split_activity_amount", "coupon_reduce_amount": "split_coupon_amount", "order_amount": "split_total_amount"}


def line_versions(df: DataFrame) -> DataFrame:
    """Order lines with decimal amounts, every version preceded by the last one's retraction."""
    out = df.select("id", "order_id", "sku_id", "province_id", *(F.col(old).try_cast(schemas.MONEY).alias(new) for new, old in LINE_AMOUNTS.items()), "et")
    out = out.where(F.col("id").isNotNull())
    return P.with_state(out, "id", P.Retraction(out.schema, tuple(LINE_AMOUNTS), None), out.schema, "EventTime", "et")


@program
def dws_trade_sku_order_window(spark: SparkSession, places: Places):
    sums = windows.sku_orders(line_versions(order_lines(spark, places, "0 seconds")), "et", places.window)
    names = {n: places.dim(spark, n) for n in ("dim_sku_info", "dim_spu_info", "dim_base_trademark", "dim_base_category3", "dim_base_category2", "dim_base_category1")}
    return places.to_result(enrich.sku_snowflake(sums, names), "dws_trade_sku_order_window", "dws_sku")


@program
def dws_trade_province_order_window(spark: SparkSession, places: Places):
    lines = line_versions(order_lines(spark, places, "0 seconds")).select("order_id", "province_id", "order_amount", "et")
    sums = windows.province_orders(lines, "et", places.window, streaming=True)
    return places.to_result(enrich.province(sums, places.dim(spark, "dim_base_province")), "dws_trade_province_order_window", "dws_province")


# ------------------------------------------------------------------ serving


@program
def serving_http(spark: SparkSession, places: Places, port: int = 0):
    """The results over HTTP; each request reads the folder of its day."""
    of = lambda name: lambda: places.result(spark, name)
    return serving.server(of("dws_trade_province_order_window"), of("dws_traffic_vc_ch_ar_is_new_page_view_window"), port)
