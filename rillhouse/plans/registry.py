"""Queries over the star tables, each through the package's operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas, sources
from ..functions import dates, names, text
from ..operators import config, enrich, etl, facts, state, windows
from ..runtime import shared_dir, table
from ..streaming import processors, sinks
from . import serving
from . import standins as s

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def amount(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


def whole_numbers(spark: SparkSession, few: DataFrame, c: str) -> DataFrame:
    """A few rows (a row a branch) whose exact decimal sums in c become longs, as in the SQL, if every one fits.

    Millions of milliseconds since 1970 add up to more than a long holds; then, where the SQL has no result, all stay decimals.
    """
    rows = few.collect()
    kept = spark.createDataFrame(rows, few.schema)
    return kept.withColumn(c, F.col(c).cast("long")) if all(r[c] is None or -(2**63) <= r[c] < 2**63 for r in rows) else kept


DETAIL = """l AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id FROM lineitem)"""
STT = "strftime(time_bucket(INTERVAL {w}, ts), '%Y-%m-%d %H:%M:%S') AS stt, strftime(time_bucket(INTERVAL {w}, ts) + INTERVAL {w}, '%Y-%m-%d %H:%M:%S') AS edt, strftime(time_bucket(INTERVAL {w}, ts), '%Y-%m-%d') AS cur_date"


# ------------------------------------------------------------------ serving


def province_table(spark: SparkSession, sf: str) -> DataFrame:
    """Order count and amount by day and province: lines, orders, customers, and the nation's name."""
    li = table(spark, sf, "lineitem").select("l_orderkey", amount("l_extendedprice").alias("a"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("cur_date"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    # lines are summed before the joins: one row an order goes on
    per_order = li.groupBy("l_orderkey").agg(F.sum("a").alias("a"))
    rows = per_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy("cur_date", F.col("c_nationkey").alias("province_id")).agg(F.count(F.lit(1)).alias("order_count"), F.sum("a").alias("order_amount"))
    return enrich.enrich(out, table(spark, sf, "nation"), "province_id", "n_nationkey", province_name="n_name")


@query(
    "q2_province_amount",
    """SELECT n_name AS province_name, strftime(o_orderdate, '%Y-%m-%d') AS cur_date, count(DISTINCT o_orderkey) AS order_count,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS order_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def q2(spark, sf):
    return province_table(spark, sf).select("province_name", "cur_date", "order_count", F.col("order_amount").cast("double").alias("order_amount"))


@query(
    "q1_gmv",
    """SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS order_amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE strftime(o_orderdate, '%Y-%m-%d') = '1996-06-14'""",
)
def q1(spark, sf):
    return serving.gmv(province_table(spark, sf), 19960614).select(F.col("order_amount").cast("double").alias("order_amount"))


@query(
    "q2_province_day",
    """SELECT n_name AS province_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS order_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE strftime(o_orderdate, '%Y-%m-%d') = '1996-06-14' GROUP BY 1""",
)
def q2_day(spark, sf):
    return serving.province_amount(province_table(spark, sf), "19960614").select("province_name", F.col("order_amount").cast("double").alias("order_amount"))


@query(
    "q3_top_channels",
    """SELECT 'ch' || (user_id % 5) AS ch, CAST(count(DISTINCT user_id) AS BIGINT) AS uv_ct FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05' GROUP BY 1 ORDER BY uv_ct DESC, ch LIMIT 10""",
)
def q3(spark, sf):
    p = state.first_per_day(s.page_events(spark, sf), F.to_date("ts"), "uid", order=("ts", "event_id"))
    views = windows.page_views(p, "ts", "1 day")
    return serving.channel_visitors(views, "20240105")


# ------------------------------------------------------------------ envelopes and cleaning


@query("p2_cdc_filter", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS order_status, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders WHERE o_orderkey % 5 <> 0")
def p2(spark, sf):
    """Every fifth change is of a kind or database that goes."""
    e = s.orders(spark, sf).withColumn("n", F.col("data")["id"].cast("long"))
    e = e.withColumn("type", F.when(F.col("n") % 10 == 0, F.lit("bootstrap-start")).otherwise(F.col("type"))).withColumn("database", F.when(F.col("n") % 10 == 5, F.lit("other")).otherwise(F.col("database")))
    return etl.fields(etl.dim_changes(e, s.DB), "id", "user_id", "order_status")


@query("p3_live_changes", "SELECT CASE WHEN o_orderkey % 3 = 1 THEN 'insert' ELSE 'update' END AS type, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def p3(spark, sf):
    n = F.col("data")["id"].cast("long") % 3
    e = s.orders(spark, sf).withColumn("type", F.when(n == 0, "bootstrap-insert").when(n == 1, "insert").otherwise("update"))
    return etl.live_changes(e).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p4_dirty_split",
    "SELECT branch, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'dirty' ELSE 'clean' END AS branch, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(props->>'k' AS BIGINT) END AS k FROM events) GROUP BY 1",
)
def p4(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("value"))
    good, bad = etl.split_dirty(e)
    k = F.get_json_object("value", "$.k").cast("long")
    out = good.select(F.lit("clean").alias("branch"), k.alias("k")).unionByName(bad.select(F.lit("dirty").alias("branch"), F.lit(None).cast("long").alias("k")))
    return out.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("p5_prune_columns", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS order_status, 'insert' AS type, CAST(3 AS BIGINT) AS n_keys, CAST(NULL AS VARCHAR) AS user_id FROM orders")
def p5(spark, sf):
    d = s.orders(spark, sf).select(etl.with_operation(etl.prune(F.col("data"), F.lit("id, order_status")), F.col("type")).alias("d"))
    return d.select(*(F.col("d")[c].alias(c) for c in ("id", "order_status", "type")), F.size("d").cast("long").alias("n_keys"), F.col("d")["user_id"].alias("user_id"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as versions of one cart: the number of items changes from order to order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf, "orders").select("*", (F.col("o_orderkey") % 6).alias("num")).select("*", F.lag("num").over(w).alias("before"), F.lag("o_orderstatus").over(w).alias("status_before"))
    kind = F.when(F.col("before").isNull(), "insert").otherwise("update")
    old = F.when(F.col("before").isNotNull(), s.text_map(sku_num=F.col("before"), status=F.col("status_before")))
    return s.envelope(o, "cart_info", F.col("o_orderdate"), kind, old, id=F.col("o_custkey"), user_id=F.col("o_custkey"), sku_id=F.col("o_orderkey"), sku_num=F.col("num"), status=F.col("o_orderstatus"))


LAGS = "v AS (SELECT *, o_orderkey % 6 AS num, lag(o_orderkey % 6) OVER w AS before, lag(o_orderstatus) OVER w AS status_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"


@query("p9_status_change", f"WITH {LAGS} SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS sku_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM v WHERE status_before IS NOT NULL AND o_orderstatus = 'P'")
def p9(spark, sf):
    return etl.fields(etl.became(versions(spark, sf), "status", "P"), "id", "sku_id")


@query("p10_transition", f"WITH {LAGS} SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS sku_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM v WHERE status_before = 'O' AND o_orderstatus = 'F'")
def p10(spark, sf):
    return etl.fields(etl.moved(versions(spark, sf), "status", "O", "F"), "id", "sku_id")


@query(
    "p11_cart_add",
    f"WITH {LAGS} SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS sku_id, CAST(num - coalesce(before, 0) AS VARCHAR) AS sku_num, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM v WHERE before IS NULL OR num > before",
)
def p11(spark, sf):
    return facts.cart_add(versions(spark, sf))


@query("p12_page_filter", "SELECT event_type AS page_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def p12(spark, sf):
    return etl.home_and_detail(s.page_events(spark, sf), "view", "click").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p13_login_filter",
    "SELECT event_id FROM (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_page FROM events) WHERE user_id % 4 <> 0 AND (last_page = 'signup' OR coalesce(last_page, '') = '')",
)
def p13(spark, sf):
    p = s.page_events(spark, sf).withColumn("last_page_id", F.lag("page_id").over(Window.partitionBy("uid").orderBy("ts", "event_id"))).withColumn("uid", F.when(F.col("uid") % 4 != 0, F.col("uid").cast("string")).otherwise(""))
    return etl.logins(p, "signup").select("event_id")


@query(
    "p16_log_split",
    """SELECT branch, CAST(count(*) AS BIGINT) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM (
  SELECT CASE WHEN event_type = 'error' THEN 'err' END AS branch, NULL AS ms FROM events WHERE event_type = 'error'
  UNION ALL SELECT 'start', epoch_us(ts) // 1000 FROM events WHERE event_type IN ('error', 'signup')
  UNION ALL SELECT 'page', epoch_us(ts) // 1000 FROM events WHERE event_type NOT IN ('error', 'signup')
  UNION ALL SELECT 'display', epoch_us(ts) // 1000 FROM events, range(2) WHERE event_type NOT IN ('error', 'signup')
  UNION ALL SELECT 'action', epoch_us(ts) // 1000 FROM events WHERE event_type = 'click') GROUP BY 1""",
)
def p16(spark, sf):
    e, kind = table(spark, sf, "events"), F.col("event_type")
    ms = F.unix_millis(F.to_timestamp("ts"))
    begin = kind.isin("error", "signup")
    log = F.struct(
        F.struct(F.col("user_id").cast("string").alias("mid")).alias("common"),
        F.when(~begin, F.struct(kind.alias("page_id"), F.floor("value").cast("long").alias("during_time"))).alias("page"),
        F.when(begin, F.struct(F.lit("icon").alias("entry"))).alias("start"),
        F.when(kind == "error", F.struct(F.lit(1).alias("error_code"))).alias("err"),
        F.when(~begin, F.array(F.struct(F.lit("1").alias("item")), F.struct(F.lit("2").alias("item")))).alias("displays"),
        F.when(kind == "click", F.array(F.struct(F.lit("fav").alias("action_id")))).alias("actions"),
        ms.alias("ts"),
    )
    rows = etl.tag_log(e.select(F.to_json(log).alias("value")))
    out = rows.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("branch") != "err", F.col("ts")).cast("decimal(38,0)")).alias("ms"))
    return whole_numbers(spark, out, "ms")


@query("p16_explode", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def p16_explode(spark, sf):
    """Lines nested in their order and taken apart again."""
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber")).alias("items"))
    return nested.select("l_orderkey", F.explode("items").alias("i")).groupBy("l_orderkey", F.col("i.l_linenumber").alias("l_linenumber")).agg(F.count(F.lit(1)).alias("n"))


@query("p17_amounts", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(16,2)) * CAST(l_extendedprice AS DECIMAL(16,2))) AS DOUBLE) AS original_amount FROM lineitem GROUP BY 1")
def p17(spark, sf):
    """Text amounts become decimals, their products are exact."""
    d = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("string").alias("q"), s.money("l_extendedprice").cast("string").alias("p"))
    return d.groupBy("l_returnflag").agg(F.sum(F.col("q").try_cast("decimal(16,2)") * F.col("p").try_cast("decimal(16,2)")).cast("double").alias("original_amount"))


@query("p18_json_record", "SELECT CAST(r_regionkey AS BIGINT) AS k, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS record FROM region")
def p18(spark, sf):
    rec = etl.to_record(table(spark, sf, "region").select("r_regionkey", "r_name", F.lit("x").alias("hidden")), "hidden")
    return rec.select(F.get_json_object("value", "$.r_regionkey").cast("long").alias("k"), F.col("value").alias("record"))


# ------------------------------------------------------------------ joins


def detail_fact(spark: SparkSession, sf: str) -> DataFrame:
    db = s.details(spark, sf).unionByName(s.orders(spark, sf)).unionByName(s.activities(spark, sf)).unionByName(s.coupons(spark, sf))
    return facts.order_detail(db, s.DB)


FACT = f"""WITH {DETAIL},
a AS (SELECT id, CAST(max(l_suppkey) AS VARCHAR) AS activity_id, CAST(max(l_suppkey) % 7 AS VARCHAR) AS activity_rule_id FROM l WHERE l_discount > 0.05 GROUP BY id),
c AS (SELECT id, CAST(max(l_linenumber) AS VARCHAR) AS coupon_id FROM l WHERE l_returnflag = 'R' GROUP BY id),
f AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS sku_id, CAST(o_custkey % 25 AS VARCHAR) AS province_id, activity_id, activity_rule_id, coupon_id,
  strftime(l_shipdate, '%Y-%m-%d') AS date_id, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS sku_num, CAST(CAST(l_quantity AS DECIMAL(16,2)) * CAST(l_extendedprice AS DECIMAL(16,2)) AS DOUBLE) AS original, CAST(CAST(l_extendedprice AS DECIMAL(16,2)) AS DOUBLE) AS total, CAST(epoch(l_shipdate) AS BIGINT) AS ts
  FROM l JOIN orders ON l_orderkey = o_orderkey LEFT JOIN a USING (id) LEFT JOIN c USING (id))"""


@query("j1_order_detail", f"{FACT} SELECT * FROM f")
def j1(spark, sf):
    return detail_fact(spark, sf).select("order_id", "user_id", "sku_id", "province_id", "activity_id", "activity_rule_id", "coupon_id", "date_id", "sku_num", F.col("split_original_amount").cast("double").alias("original"), F.col("split_total_amount").cast("double").alias("total"), "ts")


CANCEL = f"{FACT}, k AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS cancel_time FROM orders WHERE o_orderstatus = 'P')"


def cancel(spark: SparkSession, sf: str, how: str) -> DataFrame:
    db = s.order_updates(spark, sf, "1001", "1003", "P").unionByName(s.order_updates(spark, sf, "1001", "1002", "F"))
    return facts.order_cancel(detail_fact(spark, sf), db, how).select("order_id", "sku_id", "sku_num", F.col("split_total_amount").cast("double").alias("total"), "cancel_time", "date_id")


@query("j3_order_cancel", f"{CANCEL} SELECT order_id, sku_id, sku_num, total, cancel_time, cancel_time[:10] AS date_id FROM f JOIN k USING (order_id)")
def j3(spark, sf):
    return cancel(spark, sf, "inner")


@query("j3_order_cancel_left", f"{CANCEL} SELECT order_id, sku_id, sku_num, total, cancel_time, cancel_time[:10] AS date_id FROM f LEFT JOIN k USING (order_id)")
def j3_left(spark, sf):
    return cancel(spark, sf, "left")


@query(
    "j4_interval_join",
    "SELECT p.event_id AS purchase, c.event_id AS click, p.user_id AS user_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts >= p.ts - INTERVAL 30 MINUTE AND c.ts <= p.ts + INTERVAL 5 SECOND WHERE p.event_type = 'purchase' AND c.event_type = 'click'",
)
def j4(spark, sf):
    """The interval join of payments over events: a click stands for the order line."""
    e = table(spark, sf, "events")
    click = e.where("event_type = 'click'").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("click"), F.col("ts").alias("d_et"))
    pay = e.where("event_type = 'purchase'").select(F.col("user_id").alias("p_order"), F.col("event_id").alias("purchase"), F.col("ts").alias("p_et"))
    return facts.in_interval(pay, click, "order_id = p_order", "d_et", "p_et", "30 minutes", "5 seconds").select("purchase", "click", F.col("order_id").alias("user_id"))


@query(
    "j4_payment_success",
    f"""{FACT} SELECT f.order_id, f.sku_id, f.user_id, f.sku_num, f.total, 'name of ' || o_orderpriority AS payment_type_name FROM f JOIN orders ON f.order_id = CAST(o_orderkey AS VARCHAR)
WHERE o_orderstatus = 'F' AND f.ts >= epoch(o_orderdate) + 3600 - 30 * 86400 AND f.ts <= epoch(o_orderdate) + 3600 + 5""",
)
def j4_pay(spark, sf):
    """Payments within thirty days of a line (the tables' dates are days)."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    t = F.col("o_orderdate") + F.expr("interval 1 hour")
    pay = s.envelope(o, "payment_info", t, "update", s.text_map(payment_status=F.lit("1601")), order_id=F.col("o_orderkey"), user_id=F.col("o_custkey"), payment_type=F.col("o_orderpriority"), callback_time=F.date_format(t, "yyyy-MM-dd HH:mm:ss"), payment_status=F.lit("1602"))
    out = facts.payment_success(detail_fact(spark, sf), pay, s.dictionary(spark, sf), early="30 days")
    return out.select("order_id", "sku_id", "user_id", "sku_num", F.col("split_payment_amount").cast("double").alias("total"), "payment_type_name")


@query("j6_lookup_dic", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, o_orderpriority AS appraise, 'name of ' || o_orderpriority AS appraise_name, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders")
def j6(spark, sf):
    o = table(spark, sf, "orders")
    db = s.envelope(o, "comment_info", F.col("o_orderdate"), id=F.col("o_orderkey"), user_id=F.col("o_custkey"), sku_id=F.col("o_orderkey"), appraise=F.col("o_orderpriority"), comment_txt=F.lit("good"))
    return facts.comment_info(db, s.dictionary(spark, sf)).select("id", "user_id", "appraise", "appraise_name", "ts")


@query(
    "j7_double_lookup",
    """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku_id, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS refund_type_name,
CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'final' END AS refund_reason_type_name, CAST(o_custkey % 25 AS VARCHAR) AS province_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""",
)
def j7(spark, sf):
    li = table(spark, sf, "lineitem")
    r = s.envelope(li, "order_refund_info", F.col("l_shipdate"), id=s.line_id(), user_id=F.col("l_suppkey"), order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"), refund_type=F.col("l_returnflag"), refund_reason_type=F.col("l_linestatus"), refund_num=F.col("l_linenumber"), refund_amount=s.money("l_extendedprice"), refund_reason_txt=F.lit("-"), create_time=s.moment("l_shipdate"))
    dic = spark.sql("select * from values ('R', 'returned'), ('A', 'accepted'), ('N', 'none'), ('O', 'open'), ('F', 'final') as t(dic_code, dic_name)")
    return facts.order_refund(r.unionByName(s.order_updates(spark, sf, "1004", "1005", "F")), dic).select("order_id", "sku_id", "refund_type_name", "refund_reason_type_name", "province_id")


@query(
    "j8_composite_join",
    f"""WITH {DETAIL} SELECT p.id AS id, CAST(p.l_orderkey AS VARCHAR) AS order_id, CAST(p.l_partkey AS VARCHAR) AS sku_id, CAST(r.l_linenumber AS VARCHAR) AS refund_num, CAST(o_custkey AS VARCHAR) AS user_id, 'returned' AS payment_type_name
FROM l p JOIN l r ON p.l_orderkey = r.l_orderkey AND p.l_partkey = r.l_partkey JOIN orders ON p.l_orderkey = o_orderkey WHERE p.l_returnflag = 'R' AND o_orderstatus = 'F'""".replace("p.id AS id, ", ""),
)
def j8(spark, sf):
    li = table(spark, sf, "lineitem")
    p = s.envelope(li.where("l_returnflag = 'R'"), "refund_payment", F.col("l_shipdate"), "update", s.text_map(refund_status=F.lit("0")), id=s.line_id(), order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"), payment_type=F.col("l_returnflag"), callback_time=s.moment("l_shipdate"), total_amount=s.money("l_extendedprice"), refund_status=F.lit("1602"))
    r = s.envelope(li, "order_refund_info", F.col("l_shipdate"), "update", s.text_map(refund_status=F.lit("0")), order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"), refund_num=F.col("l_linenumber"), refund_status=F.lit("0705"))
    dic = spark.sql("select * from " + s.flags())
    out = facts.refund_payment_success(p.unionByName(r).unionByName(s.order_updates(spark, sf, "1005", "1006", "F")), dic)
    return out.select("order_id", "sku_id", "refund_num", "user_id", "payment_type_name")


@query(
    "j9_snowflake_enrich",
    """SELECT l_orderkey, l_linenumber, p_name AS sku_name, s_name AS spu_name, n_name AS category3_name, r_name AS category2_name FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) x
LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def j9(spark, sf):
    """A chain of left lookups over whole tables."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    out = enrich.enrich(li, table(spark, sf, "part"), "l_partkey", "p_partkey", sku_name="p_name")
    out = enrich.enrich(out, table(spark, sf, "supplier"), "l_suppkey", "s_suppkey", spu_name="s_name", nation="s_nationkey")
    out = enrich.enrich(out, table(spark, sf, "nation"), "nation", "n_nationkey", category3_name="n_name", region="n_regionkey")
    return enrich.enrich(out, table(spark, sf, "region"), "region", "r_regionkey", category2_name="r_name").select("l_orderkey", "l_linenumber", "sku_name", "spu_name", "category3_name", "category2_name")


@query(
    "j11_config_route_dim",
    "SELECT 'dim_order' AS sink_table, CAST(o_orderkey AS VARCHAR) AS row_key, 'insert' AS type, o_orderstatus AS order_status, CAST(3 AS BIGINT) AS n_keys FROM orders",
)
def j11(spark, sf):
    c = spark.createDataFrame([("order_info", "dim_order", "id,order_status", "info", "id", "r"), ("unused", "dim_unused", "id", "info", "id", "r")], "source_table string, sink_table string, sink_columns string, sink_family string, sink_row_key string, op string")
    out = config.route_dim(etl.dim_changes(s.orders(spark, sf).unionByName(s.coupons(spark, sf)), s.DB), c)
    return out.select("sink_table", "row_key", "type", F.col("data")["order_status"].alias("order_status"), F.size("data").cast("long").alias("n_keys"))


@query(
    "j12_config_route_fact",
    f"WITH {DETAIL} SELECT topic, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'fact_coupon_use' AS topic FROM l WHERE l_returnflag = 'R' GROUP BY id UNION ALL SELECT 'fact_user_register' FROM customer) GROUP BY 1",
)
def j12(spark, sf):
    users = s.envelope(table(spark, sf, "customer"), "user_info", F.lit("2024-01-01 00:00:00"), id=F.col("c_custkey"), nick_name=F.col("c_name"))
    c = spark.createDataFrame([("order_detail_coupon", "insert", "fact_coupon_use", "order_detail_id,coupon_id", "r"), ("user_info", "insert", "fact_user_register", "id", "r"), ("user_info", "update", "fact_user_change", "id", "r")], "source_table string, source_type string, sink_table string, sink_columns string, op string")
    return config.route_fact(etl.live_changes(s.coupons(spark, sf).unionByName(users)), c).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def _j13(how: str, sql_how: str):
    @query(f"j13_{how}", f"SELECT c_custkey, o_orderkey FROM customer {sql_how} JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
    def run(spark, sf):
        """Whole tables; who has no partner with status P has nulls, as the kind of join says."""
        c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        return facts.relate(c, o, "c_custkey = o_custkey and o_orderstatus = 'P'", how).select("c_custkey", "o_orderkey")


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _j13(_how, _sql)


@query("j14_keywords", "SELECT keyword, CAST(count(*) AS BIGINT) AS keyword_count FROM (SELECT unnest(string_split_regex(lower(replace(r_name || ' ' || n_name || '-' || n_nationkey, 'I', 'i')), '[^a-z0-9]+')) AS keyword FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE keyword <> '' GROUP BY 1")
def j14(spark, sf):
    """Lateral join with the table function."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    terms = n.select(F.concat("r_name", F.lit(" "), "n_name", F.lit("-"), "n_nationkey").alias("full_word"))
    return text.keywords(terms).groupBy("keyword").agg(F.count(F.lit(1)).alias("keyword_count"))


@query("j14_words_sql", "SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS word FROM part) WHERE word <> '' GROUP BY 1")
def j14_sql(spark, sf):
    """The same without Python: split and explode."""
    return table(spark, sf, "part").select(F.explode(text.words("p_name")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ windows and state

UV = "e AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS uv FROM events)"


def _a1(name: str, size: str, w: str):
    @query(
        name,
        f"WITH {UV} SELECT {STT.format(w=w)}, 'v' || (user_id % 3) AS vc, 'ch' || (user_id % 5) AS ch, CAST(user_id % 7 AS VARCHAR) AS ar, CAST(event_id % 2 AS VARCHAR) AS is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS sv_ct, CAST(count(*) AS BIGINT) AS pv_ct, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS dur_sum FROM e GROUP BY ALL",
    )
    def run(spark, sf):
        return windows.page_views(state.first_per_day(s.page_events(spark, sf), F.to_date("ts"), "uid", order=("ts", "event_id")), "ts", size)


_a1("a1_page_view_window", "10 seconds", "10 SECOND")
_a1("a1_page_view_hour", "1 hour", "1 HOUR")


@query(
    "a2_sku_order_window",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS cur_date, CAST(l_partkey AS VARCHAR) AS sku_id, CAST(sum(CAST(l_quantity AS DECIMAL(16,2)) * CAST(l_extendedprice AS DECIMAL(16,2))) AS DOUBLE) AS original_amount, CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2))) AS DOUBLE) AS order_amount, CAST(0 AS DOUBLE) AS coupon_reduce_amount
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) AS n FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE n = 1 GROUP BY 1, 2""",
)
def a2(spark, sf):
    """Lines come in several versions: the last one counts, then sums by day and sku."""
    li = table(spark, sf, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    last = state.latest_version(li, "id", *(F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    rows = last.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("o_orderdate", F.col("l_partkey").cast("string").alias("sku_id"), (F.col("l_quantity").cast("decimal(16,2)") * s.money("l_extendedprice")).alias("original_amount"), F.lit(0).cast("decimal(16,2)").alias("activity_reduce_amount"), F.lit(None).cast("decimal(16,2)").alias("coupon_reduce_amount"), s.money("l_extendedprice").alias("order_amount"))
    return windows.sku_orders(rows, "o_orderdate", "1 day").select("cur_date", "sku_id", *(F.col(c).cast("double").alias(c) for c in ("original_amount", "order_amount", "coupon_reduce_amount")))


@query(
    "a3_province_order_window",
    f"SELECT strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS stt, CAST(o_custkey % 25 AS VARCHAR) AS province_id, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS order_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2))) AS DOUBLE) AS order_amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
def a3(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("o_orderdate", (F.col("o_custkey") % 25).cast("string").alias("province_id"), F.col("l_orderkey").alias("order_id"), s.money("l_extendedprice").alias("order_amount"))
    return windows.province_orders(rows, "o_orderdate", "1 day").select("stt", "province_id", "order_count", F.col("order_amount").cast("double").alias("order_amount"))


@query(
    "a4_home_detail_uv",
    f"""WITH h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS first FROM events WHERE event_type IN ('view', 'click'))
SELECT {STT.format(w="1 HOUR")}, CAST(sum(CASE WHEN event_type = 'view' THEN first ELSE 0 END) AS BIGINT) AS home_uv_ct, CAST(sum(CASE WHEN event_type = 'click' THEN first ELSE 0 END) AS BIGINT) AS good_detail_uv_ct FROM h WHERE first = 1 GROUP BY ALL""",
)
def a4(spark, sf):
    p = state.first_per_day(s.page_events(spark, sf).where(F.col("page_id").isin("view", "click")), F.to_date("ts"), "uid", "page_id", order=("ts", "event_id"), flag="first").where("first = 1")
    return windows.home_detail(p.select("ts", (F.col("page_id") == "view").cast("long").alias("home_uv"), (F.col("page_id") == "click").cast("long").alias("detail_uv")), "ts", "1 hour")


@query(
    "a5_user_login",
    """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), x AS (SELECT day, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day) >= 8 THEN 1 ELSE 0 END AS back FROM d)
SELECT strftime(day, '%Y-%m-%d') AS cur_date, CAST(sum(back) AS BIGINT) AS back_ct, CAST(count(*) AS BIGINT) AS uu_ct FROM x GROUP BY 1""",
)
def a5(spark, sf):
    rows = state.returning_users(table(spark, sf, "orders"), "o_custkey", F.to_date("o_orderdate")).withColumn("et", F.col("day").cast("timestamp_ntz"))
    return windows.logins(rows, "et", "1 day").select("cur_date", "back_ct", "uu_ct")


@query("a6_cart_uu", f"WITH {UV} SELECT {STT.format(w='10 SECOND')}, CAST(count(*) AS BIGINT) AS cart_add_uu_ct FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1) GROUP BY ALL")
def a6(spark, sf):
    p = state.first_per_day(s.page_events(spark, sf).where("page_id = 'purchase'"), F.to_date("ts"), "uid", order=("ts", "event_id"), flag="n").where("n = 1")
    return windows.cart_users(p, "ts")


@query("a7_keyword_window", f"SELECT {STT.format(w='1 DAY')}, keyword, CAST(count(*) AS BIGINT) AS keyword_count FROM (SELECT ts, unnest(string_split_regex(event_type || ' user' || (user_id % 10), '[^a-z0-9]+')) AS keyword FROM events) WHERE keyword <> '' GROUP BY ALL")
def a7(spark, sf):
    e = table(spark, sf, "events").select("ts", F.explode(text.words(F.concat("event_type", F.lit(" user"), F.col("user_id") % 10))).alias("keyword"))
    return windows.keywords(e, "ts", "1 day")


@query("a8_sum_of_nothing", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS order_amount FROM lineitem WHERE l_orderkey < 0")
def a8(spark, sf):
    """A day without orders sums to null."""
    return serving.gmv(province_table(spark, sf), "19000101").select(F.col("order_amount").cast("double").alias("order_amount"))


@query(
    "w5_first_per_day",
    "SELECT event_id, CAST(CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS uv FROM events",
)
def w5(spark, sf):
    return state.first_per_day(s.page_events(spark, sf), F.to_date("ts"), "uid", order=("ts", "event_id")).select("event_id", "uv")


@query(
    "w6_retraction",
    "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2))) AS DOUBLE) AS order_amount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey ORDER BY l_shipdate DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC) AS n FROM lineitem) WHERE n = 1 GROUP BY 1",
)
def w6(spark, sf):
    """Sums over versions and their retractions equal sums over the last versions."""
    li = table(spark, sf, "lineitem").select("*", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("id"), s.money("l_extendedprice").alias("order_amount"))
    order = tuple(F.asc(c) for c in ("l_shipdate", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return state.retractions(li, "id", order, ("order_amount",)).groupBy("l_suppkey").agg(F.sum("order_amount").cast("double").alias("order_amount"))


@query(
    "w8_visitor_repair",
    """WITH b AS (SELECT event_id, ts, CAST(event_id % 2 AS VARCHAR) AS is_new, first_value(CASE WHEN event_id % 2 = 1 THEN CAST(ts AS DATE) ELSE CAST(CAST(ts AS DATE) - INTERVAL 1 DAY AS DATE) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_day FROM events)
SELECT event_id, CASE WHEN is_new = '1' AND first_day <> CAST(ts AS DATE) THEN '0' ELSE is_new END AS is_new FROM b""",
)
def w8(spark, sf):
    return etl.repair_visitors(s.page_events(spark, sf), "uid", F.to_date("ts"), "is_new", "ts", "event_id").select("event_id", "is_new")


@query("w9_returning_users", "WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT o_custkey, strftime(day, '%Y-%m-%d') AS day, CAST(1 AS BIGINT) AS uu, CAST(CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day) >= 8 THEN 1 ELSE 0 END AS BIGINT) AS back FROM d")
def w9(spark, sf):
    return state.returning_users(table(spark, sf, "orders"), "o_custkey", F.to_date("o_orderdate")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# ------------------------------------------------------------------ functions


@query(
    "f_dates",
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS time, strftime(ts, '%Y%m%d') AS part, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS before, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS days,
CAST(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) * 1000 AS BIGINT) AS day_ms, strftime(date_trunc('second', ts) - INTERVAL 3 SECOND, '%Y-%m-%d %H:%M:%S') AS late FROM events""",
)
def f_dates(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.unix_millis(F.to_timestamp("ts")).alias("ms"))
    return e.select("event_id", "ms", dates.millis_to_day("ms").alias("day"), dates.millis_to_time("ms").alias("time"), dates.millis_to_partition("ms").alias("part"), dates.day_before("ms").alias("before"), dates.days_since(F.timestamp_millis("ms"), F.lit("2024-01-01")).cast("long").alias("days"), dates.text_to_millis(dates.millis_to_day("ms")).alias("day_ms"), F.date_format(F.timestamp_millis("ms") - F.expr("interval 3 seconds"), dates.TIME).alias("late"))


@query(
    "f_casts",
    "SELECT o_orderkey, CAST(CAST(o_orderkey AS VARCHAR) AS INTEGER) AS n, CAST(CAST(o_totalprice AS DECIMAL(16,2)) AS DOUBLE) AS price, CAST(NULL AS INTEGER) AS bad, CAST(o_orderkey % 7 - 3 AS BIGINT) AS diff, o_orderkey // 7 AS whole, -CAST(CAST(o_totalprice AS DECIMAL(16,2)) AS DOUBLE) AS negated, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM orders",
)
def f_casts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("t"), s.money("o_totalprice").alias("p"))
    return o.select("o_orderkey", F.col("t").cast("int").alias("n"), F.col("p").cast("double").alias("price"), F.concat("t", F.lit("x")).try_cast("int").alias("bad"), (F.col("o_orderkey") % 7 - 3).alias("diff"), F.expr("o_orderkey div 7").alias("whole"), (-F.coalesce("p", F.lit(0))).cast("double").alias("negated"), F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("parity"))


@query("f_json", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, '{\"k\":' || (props->>'k') || ',\"id\":' || event_id || '}' AS again, CAST(NULL AS VARCHAR) AS missing FROM events")
def f_json(spark, sf):
    e = table(spark, sf, "events").withColumn("p", F.from_json("props", "k long, id long"))
    return e.select("event_id", "p.k", F.to_json(F.col("p").withField("id", F.col("event_id"))).alias("again"), F.get_json_object("props", "$.none").alias("missing"))


@query("f_maps", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(NULL AS VARCHAR) AS none, CAST(2 AS BIGINT) AS n, n_name AS inner_name FROM nation")
def f_maps(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", s.text_map(name=F.col("n_name"), region=F.col("n_regionkey")).alias("m"), F.struct(F.struct(F.col("n_name").alias("dic_name")).alias("info")).alias("dic"))
    return n.select(F.col("n_nationkey").cast("long").alias("k"), F.col("m")["name"].alias("name"), F.col("m")["none"].alias("none"), F.size("m").cast("long").alias("n"), F.col("dic.info.dic_name").alias("inner_name"))


@query(
    "f_arrays",
    "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n, string_split(p_name, ' ')[1] AS first, list_contains(string_split(p_name, ' '), string_split(p_name, ' ')[1]) AS has, array_to_string(string_split(p_name, ' '), ',') AS joined FROM part",
)
def f_arrays(spark, sf):
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), F.size(w).cast("long").alias("n"), w[0].alias("first"), F.array_contains(w, w[0]).alias("has"), F.array_join(w, ",").alias("joined"))


@query("f_sets", "SELECT o_custkey, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n FROM orders GROUP BY 1")
def f_sets(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.size(F.collect_set("o_orderstatus")).cast("long").alias("n"))


@query("f_strings", "SELECT CAST(c_custkey AS BIGINT) AS k, starts_with(c_name, 'Customer') AS starts, c_mktsegment || ':' || c_custkey AS joined, c_mktsegment < 'H' AS less, CAST(length(c_name) AS BIGINT) AS n, FALSE AS empty FROM customer")
def f_strings(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.startswith("c_name", F.lit("Customer")).alias("starts"), F.concat_ws(":", "c_mktsegment", "c_custkey").alias("joined"), (F.col("c_mktsegment") < "H").alias("less"), F.length("c_name").cast("long").alias("n"), names.is_empty("c_name").alias("empty"))


@query("f_names", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def f_names(spark, sf):
    """Column names to camelCase and back."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    camel = names.renamed(r, names.to_camel)
    assert camel.columns == ["rRegionkey", "rName"]
    return names.renamed(camel, names.to_snake)


# ------------------------------------------------------------------ sources and sinks: written, then read again


def as_topic(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows as JSON records of a topic, read back."""
    place = shared_dir(spark, "topic")
    etl.to_record(df).write.text(place)
    return sources.topic(spark, place)


def as_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as files that a stream finds in a folder."""
    place = shared_dir(spark, "arrivals")
    rows = table(spark, sf, name)
    rows.write.parquet(place)
    return spark.readStream.schema(rows.schema).parquet(place)


def finished(q) -> None:
    q.awaitTermination()


@query("s1_topic_values", "SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def s1(spark, sf):
    return as_topic(spark, table(spark, sf, "events").select("event_id", "event_type"))


@query("s2_topic_table", "SELECT event_id, user_id, event_type FROM events")
def s2(spark, sf):
    kind = schemas.struct(event_id=schemas.L, user_id=schemas.L, event_type=schemas.S)
    return sources.from_json(as_topic(spark, table(spark, sf, "events").select("event_id", "user_id", "event_type")), kind, strict=True)


@query("s3_ods_db", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(epoch(o_orderdate) AS BIGINT) AS ts, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS et, TRUE AS has_pt FROM orders")
def s3(spark, sf):
    db = sources.ods_db(as_topic(spark, s.orders(spark, sf).drop("et")), None)
    return db.select(F.col("data")["id"].alias("id"), "ts", F.date_format("et", "yyyy-MM-dd HH:mm:ss").alias("et"), F.col("pt").isNotNull().alias("has_pt"))


def page_topic(spark: SparkSession, sf: str) -> DataFrame:
    """Events as page logs whose page object names the page before; clicks are searches by keyword."""
    e = table(spark, sf, "events")
    item = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("user "), F.col("user_id") % 10))
    page = F.struct(F.col("event_type").alias("page_id"), F.when(F.col("event_type") == "click", "search").alias("last_page_id"), F.lit("keyword").alias("item_type"), item.alias("item"))
    return as_topic(spark, e.select(page.alias("page"), F.unix_millis(F.to_timestamp("ts")).alias("ts")))


@query("s4_page_log", "SELECT event_type AS page_id, CASE WHEN event_id % 3 <> 0 THEN 'user ' || (user_id % 10) END AS item, epoch_us(ts) // 1000 AS ms FROM events")
def s4(spark, sf):
    return sources.page_log(page_topic(spark, sf), None).select(F.col("page")["page_id"].alias("page_id"), F.col("page")["item"].alias("item"), F.unix_millis("et").alias("ms"))


@query("p14_search_filter", "SELECT 'user ' || (user_id % 10) AS full_word, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' AND event_id % 3 <> 0 GROUP BY 1")
def p14(spark, sf):
    return text.search_terms(sources.page_log(page_topic(spark, sf), None)).groupBy("full_word").agg(F.count(F.lit(1)).alias("n"))


@query("p15_null_messages", "SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 4 <> 0")
def p15(spark, sf):
    """Tombstones, messages without a value, are left out when a topic is read."""
    place = shared_dir(spark, "topic")
    table(spark, sf, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("value")).write.json(place)
    return sources.topic(spark, place, "json").agg(F.count(F.lit(1)).alias("n"))


@query("s5_fact_topic", f"{FACT} SELECT order_id, sku_id, province_id, total, ts FROM f")
def s5(spark, sf):
    lines = sources.fact_topic(as_topic(spark, detail_fact(spark, sf).drop("et")), schemas.ORDER_DETAIL)
    return lines.select("order_id", "sku_id", "province_id", F.col("split_total_amount").cast("double").alias("total"), "ts")


CONFIG = "source_table string, sink_table string, sink_columns string, sink_family string, sink_row_key string, op string"


@query("s7_config_changes", "SELECT r_name AS source_table, 'dim_' || r_name AS sink_table FROM region WHERE r_regionkey <> 2")
def s7(spark, sf):
    """A snapshot of configuration rows, then one that is deleted and one that is changed: what is left."""
    r = table(spark, sf, "region").select("r_regionkey", F.struct(F.col("r_name").alias("source_table"), F.concat(F.lit("dim_"), "r_name").alias("sink_table"), F.lit("id").alias("sink_columns")).alias("row"))
    first = r.select(F.lit("r").alias("op"), F.lit(None).cast(r.schema["row"].dataType).alias("before"), F.when(F.col("r_regionkey") == 1, F.col("row").withField("sink_table", F.lit("old"))).otherwise(F.col("row")).alias("after"), F.lit(1).alias("n"))
    then = r.where("r_regionkey in (1, 2)").select(F.when(F.col("r_regionkey") == 1, "u").otherwise("d").alias("op"), F.col("row").alias("before"), F.when(F.col("r_regionkey") == 1, F.col("row")).alias("after"), F.lit(2).alias("n"))
    lines = as_topic(spark, first.unionByName(then))
    changes = sources.from_json(lines, T.StructType([*schemas.config_change(schemas.DIM_CONFIG).fields, T.StructField("n", T.LongType())]))
    return config.latest(changes, "n", "source_table").select("source_table", "sink_table")


def nation_dim(spark: SparkSession, sf: str) -> str:
    """The nations, written by the dimension sink in two batches: all as inserts, then some renamed and one deleted."""
    root = shared_dir(spark, "dims")
    cfg = spark.createDataFrame([("nation", "dim_nation", "n_nationkey,n_name", "info", "n_nationkey", "r")], CONFIG)
    sink = sinks.DimSink(root, lambda: cfg)
    n = table(spark, sf, "nation")
    of = lambda df, kind, name: df.select(F.lit("nation").alias("table"), F.lit(kind).alias("type"), s.text_map(n_nationkey=F.col("n_nationkey"), n_name=name, n_regionkey=F.col("n_regionkey")).alias("data"), F.lit(1 if kind == "insert" else 2).cast("long").alias("ts"))
    sink(of(n, "insert", F.col("n_name")), 0)
    sink(of(n.where("n_nationkey % 5 = 0"), "update", F.lower("n_name")).unionByName(of(n.where("n_nationkey = 7"), "delete", F.col("n_name"))), 1)
    return sink.path("dim_nation")


DIM_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 7"


@query("k7_dim_sink", DIM_NATION)
def k7(spark, sf):
    return sources.dimension(spark, nation_dim(spark, sf)).select("n_nationkey", "n_name")


@query("s9_point_get", f"SELECT n_name FROM ({DIM_NATION}) WHERE n_nationkey = '10'")
def s9(spark, sf):
    return sources.lookup(sources.dimension(spark, nation_dim(spark, sf)), "_key", "10").select("n_name")


@query("s11_cached_get", f"SELECT n_name FROM ({DIM_NATION}) WHERE n_nationkey = '11'")
def s11(spark, sf):
    kept = sinks.Kept(lambda: sources.dimension(spark, nation_dim(spark, sf)))
    kept.read()
    return sources.lookup(kept.read(), "n_nationkey", "11").select("n_name")


@query("s13_elements", "SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) t(a)")
def s13(spark, sf):
    return sources.from_json(sources.elements(spark, '{"a":1}', '{"a":2}'), schemas.struct(a=schemas.L))


@query("s15_csv_topic", "SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS name FROM nation")
def s15(spark, sf):
    lines = table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    place = shared_dir(spark, "csv")
    lines.write.text(place)
    return sources.csv_topic(sources.topic(spark, place), "k int, name string")


@query("k1_topic_sink", "SELECT o_orderkey, o_orderstatus FROM orders")
def k1(spark, sf):
    """A stream into one topic, read back."""
    place, check = shared_dir(spark, "topic"), shared_dir(spark, "checkpoint")
    finished(sinks.topic(as_stream(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), place, check))
    return sources.from_json(sources.topic(spark, place), schemas.struct(o_orderkey=schemas.L, o_orderstatus=schemas.S))


@query("k2_routed_topics", "SELECT 'fact_' || event_type AS topic, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def k2(spark, sf):
    """A stream whose rows name their topic."""
    place, check = shared_dir(spark, "topics"), shared_dir(spark, "checkpoint")
    rows = as_stream(spark, sf, "events").select(F.concat(F.lit("fact_"), "event_type").alias("topic"), s.text_map(id=F.col("event_id")).alias("data"))
    finished(sinks.routed(rows, place, check))
    return spark.read.text(place).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("value", "$.id").cast("long")).alias("ids"))


@query(
    "k4_upsert_by_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderstatus <> 'P'""",
)
def k4(spark, sf):
    """Orders as versions of their customer's row, in two batches; a row with status P deletes it."""
    path = shared_dir(spark, "upsert")
    write = sinks.upsert(path, ("o_custkey",), "o_orderkey", "gone")
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "P").alias("gone"))
    middle = rows.agg(F.max("o_orderkey")).first()[0] // 2
    write(rows.where(F.col("o_orderkey") <= middle), 0)
    write(rows.where(F.col("o_orderkey") > middle), 1)
    return sinks.read_table(spark, path).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("k5_append_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS cur_date, CAST(count(*) AS BIGINT) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-03' AND '2024-01-06' GROUP BY 1")
def k5(spark, sf):
    """A stream appended to a result table by day, of which some days are read."""
    place, check = shared_dir(spark, "result"), shared_dir(spark, "checkpoint")
    rows = as_stream(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("cur_date"))
    finished(sinks.append(rows, place, check, "cur_date"))
    return sources.results(spark, place, "2024-01-03", "2024-01-06").groupBy("cur_date").agg(F.count(F.lit(1)).alias("n"))


@query("k8_config_tables", "SELECT * FROM (VALUES ('dim_a', 'id,name'), ('dim_c', 'id')) t(name, listed)")
def k8(spark, sf):
    """Tables of configuration changes: two created, one of them dropped again, one changed."""
    root = shared_dir(spark, "dims")
    row = lambda name, cols: (name, f"dim_{name}", cols, "info", "id", "r")
    kind = schemas.config_change(schemas.DIM_CONFIG)
    for step in ([("r", None, row("a", "id,name")), ("c", None, row("b", "id"))], [("d", row("b", "id"), None), ("c", None, row("c", "id,x"))], [("u", row("c", "id,x"), row("c", "id"))]):
        sinks.apply_config(spark, root, spark.createDataFrame(step, kind))
    names = [n for n in ("dim_a", "dim_b", "dim_c") if sinks.versions(spark, f"{root}/{n}")]
    listed = [(n, ",".join(c for c in sources.dimension(spark, f"{root}/{n}").columns if c[0] != "_")) for n in names]
    return spark.createDataFrame(listed, "name string, listed string")


@query("k11_gmv_json", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gmv, CAST(0 AS BIGINT) AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y-%m-%d') = '1996-06-14'")
def k11(spark, sf):
    """What the HTTP endpoint answers, parsed again."""
    body = serving.gmv_json(province_table(spark, sf), "19960614")
    return sources.from_json(sources.elements(spark, body), schemas.struct(data=T.DoubleType(), status=schemas.L)).select(F.col("data").alias("gmv"), "status")


@query("j5_interval_5ms", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id % 3 = b.user_id % 3 AND b.event_id BETWEEN a.event_id - 5 AND a.event_id + 5 WHERE a.event_type = 'click' AND b.event_type = 'view'")
def j5(spark, sf):
    """Five milliseconds before to five after, both bounds included; an event's number stands for its millisecond."""
    e = table(spark, sf, "events")
    side = lambda kind, id_, time, key: e.where(F.col("event_type") == kind).select(F.col("event_id").alias(id_), F.timestamp_millis("event_id").alias(time), (F.col("user_id") % 3).alias(key))
    return facts.in_interval(side("click", "a", "a_ts", "a_key"), side("view", "b", "b_ts", "b_key"), "a_key = b_key", "b_ts", "a_ts", "5 milliseconds", "5 milliseconds").select("a", "b")


@query("w10_bounded_join", "SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku_id, CAST(o_custkey AS VARCHAR) AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderdate BETWEEN l_shipdate - INTERVAL 30 DAY AND l_shipdate + INTERVAL 30 DAY")
def w10(spark, sf):
    """The order detail join with the time range that bounds a stream's state."""
    db = s.details(spark, sf).unionByName(s.orders(spark, sf))
    return facts.order_detail(db, s.DB, "30 days").select("order_id", "sku_id", "user_id")


def visits_by_state(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("uid"), F.unix_millis(F.to_timestamp("ts")).alias("ts"), (F.col("event_id") % 2).cast("string").alias("is_new"))


@query("w5_state_first_per_day", "SELECT user_id AS uid, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS ts FROM events) GROUP BY 1, 2")
def w5_state(spark, sf):
    """The keyed state of the stream, run over a batch: one first visit a user and day."""
    v = visits_by_state(spark, sf)
    first = processors.with_state(v, "uid", processors.FirstPerDay(ttl_ms=None, only_first=True), processors.plus(v.schema, "uv"), "None")
    return first.groupBy("uid", dates.millis_to_day("ts").alias("day")).agg(F.sum("uv").alias("n"))


@query("w9_state_returning", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), x AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d) SELECT CAST(user_id AS VARCHAR) AS uid, strftime(day, '%Y-%m-%d') AS day, CAST(CASE WHEN date_diff('day', before, day) >= 2 THEN 1 ELSE 0 END AS BIGINT) AS back FROM x")
def w9_state(spark, sf):
    v = visits_by_state(spark, sf)
    got = processors.with_state(v, "uid", processors.ReturningUser(gap=2, ttl_ms=None), processors.plus(v.schema, "uu", "back"), "None")
    return got.select("uid", dates.millis_to_day("ts").alias("day"), "back")


@query("f_today", "SELECT CAST(strftime(current_date, '%Y%m%d') AS BIGINT) AS today, TRUE AS has_time")
def f_today(spark, sf):
    return spark.range(1).select(F.lit(dates.today()).cast("long").alias("today"), F.current_timestamp().isNotNull().alias("has_time"))
