"""Hand-made envelopes and logs, one row for each branch."""

import json

from pyspark.sql import functions as F

from rillhouse import schemas, sources
from rillhouse.functions import dates, names, text
from rillhouse.operators import config, enrich, etl, facts, state, windows
from rillhouse.plans import serving

T0 = 1718323201


def change(table, kind, ts, data, old=None, database="shop"):
    return json.dumps({"database": database, "table": table, "type": kind, "ts": ts, "data": data, "old": old})


DB = [
    change("order_detail", "insert", T0, {"id": "1", "order_id": "10", "sku_id": "7", "sku_name": "phone", "create_time": "2024-06-14 08:00:01", "sku_num": "2", "order_price": "3.50", "split_total_amount": "6.00", "split_activity_amount": "1.00", "split_coupon_amount": None}),
    change("order_detail", "insert", T0, {"id": "2", "order_id": "11", "sku_id": "8", "sku_name": "case", "create_time": "2024-06-14 08:00:01", "sku_num": "x", "order_price": "3.50", "split_total_amount": "6.00"}),
    change("order_info", "insert", T0, {"id": "10", "user_id": "100", "province_id": "3"}),
    change("order_detail_activity", "insert", T0 + 2, {"order_detail_id": "1", "activity_id": "9", "activity_rule_id": "4"}),
    change("order_info", "update", T0 + 299, {"id": "10", "order_status": "1003", "operate_time": "2024-06-14 08:05:00"}, {"order_status": "1001"}),
    change("order_info", "update", T0 + 300, {"id": "10", "order_status": "1002"}, {"order_status": "1001"}),
    change("payment_info", "update", T0 + 100, {"user_id": "100", "order_id": "10", "payment_type": "1101", "callback_time": "2024-06-14 08:01:41", "payment_status": "1602"}, {"payment_status": "1601"}),
    change("payment_info", "update", T0 + 4000, {"user_id": "100", "order_id": "10", "payment_type": "1101", "callback_time": "late", "payment_status": "1602"}, {"payment_status": "1601"}),
    change("payment_info", "update", T0 + 100, {"order_id": "10", "payment_type": "1101", "payment_status": "1602"}, {"callback_time": "x"}),
    change("cart_info", "insert", T0, {"id": "4", "user_id": "100", "sku_id": "7", "sku_num": "1"}),
    change("cart_info", "update", T0 + 99, {"id": "5", "user_id": "100", "sku_id": "7", "sku_num": "4"}, {"sku_num": "1"}),
    change("cart_info", "update", T0 + 109, {"id": "5", "user_id": "100", "sku_id": "7", "sku_num": "2"}, {"sku_num": "4"}),
    change("comment_info", "insert", T0, {"id": "6", "user_id": "100", "sku_id": "7", "appraise": "1201", "comment_txt": "ok"}),
    change("order_refund_info", "insert", T0 + 500, {"id": "20", "user_id": "100", "order_id": "10", "sku_id": "7", "refund_type": "1502", "refund_num": "1", "refund_amount": "3.00", "refund_reason_type": "1301", "refund_reason_txt": "r", "create_time": "2024-06-14 09:00:00"}),
    change("order_info", "update", T0 + 501, {"id": "10", "province_id": "3", "user_id": "100", "order_status": "1005"}, {"order_status": "1004"}),
    change("order_refund_info", "update", T0 + 600, {"order_id": "10", "sku_id": "7", "refund_num": "1", "refund_status": "0705"}, {"refund_status": "0701"}),
    change("refund_payment", "update", T0 + 601, {"id": "30", "order_id": "10", "sku_id": "7", "payment_type": "1101", "callback_time": "2024-06-15 00:00:01", "total_amount": "3.00", "refund_status": "1602"}, {"refund_status": "1601"}),
    change("order_info", "update", T0 + 602, {"id": "10", "province_id": "3", "user_id": "100", "order_status": "1006"}, {"order_status": "1005"}),
]


def db(spark):
    return sources.ods_db(sources.elements(spark, *DB), None)


def dic(spark):
    return spark.createDataFrame([("1101", "card"), ("1201", "good"), ("1502", "money back"), ("1301", "broken")], "dic_code string, dic_name string")


def test_facts(spark):
    d = facts.order_detail(db(spark), "shop")
    (row,) = d.collect()
    assert (row["id"], row["user_id"], row["activity_id"], row["coupon_id"], row["date_id"], row["split_original_amount"], row["ts"]) == ("1", "100", "9", None, "2024-06-14", "7.0000", T0)
    assert [*d.drop("et").columns] == schemas.ORDER_DETAIL.fieldNames()
    (c,) = facts.order_cancel(d, db(spark)).collect()
    assert (c["id"], c["cancel_time"], c["date_id"]) == ("1", "2024-06-14 08:05:00", "2024-06-14")
    assert facts.order_cancel(d, db(spark).where("type = 'insert'"), "left").first()["cancel_time"] is None
    (p,) = facts.payment_success(d, db(spark), dic(spark)).collect()
    assert (p["order_detail_id"], p["payment_type_name"], p["callback_time"]) == ("1", "card", "2024-06-14 08:01:41")
    (r,) = facts.order_refund(db(spark), dic(spark)).collect()
    assert (r["id"], r["province_id"], r["refund_type_name"], r["refund_reason_type_name"]) == ("20", "3", "money back", "broken")
    (q,) = facts.refund_payment_success(db(spark), dic(spark)).collect()
    assert (q["id"], q["payment_type_name"], q["date_id"], q["refund_amount"], q["refund_num"]) == ("30", "card", "2024-06-15", "3.00", "1")
    assert {(x["id"], x["sku_num"]) for x in facts.cart_add(db(spark)).collect()} == {("4", "1"), ("5", "3")}
    assert facts.comment_info(db(spark), dic(spark)).first()["appraise_name"] == "good"


def test_dimension_changes(spark):
    rows = [change("t", k, 1, d, database=b) for k, d, b in (("insert", {"id": "1"}, "shop"), ("bootstrap-start", {"id": "1"}, "shop"), ("insert", {}, "shop"), ("insert", {"id": "1"}, "other"), ("bootstrap-insert", {"id": "2"}, "shop"), ("delete", {"id": "1"}, "shop"))]
    e = sources.ods_db(sources.elements(spark, *rows, "null"), None)
    assert sorted(r["type"] for r in etl.dim_changes(e, "shop").collect()) == ["bootstrap-insert", "delete", "insert"]
    assert etl.live_changes(e).count() == 4


def test_malformed(spark):
    import pytest

    bad = sources.elements(spark, '{"database": ')
    assert sources.ods_db(bad, None).first()["database"] is None
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        sources.from_json(bad, schemas.ENVELOPE, strict=True).collect()


def test_config(spark):
    c1 = {"source_table": "base_trademark", "sink_table": "dim_base_trademark", "sink_columns": "id,tm_name", "sink_family": "info", "sink_row_key": "id"}
    changes = [json.dumps(x) for x in ({"op": "r", "before": None, "after": c1}, {"op": "c", "before": None, "after": c1 | {"source_table": "x"}}, {"op": "d", "before": c1 | {"source_table": "x"}, "after": None})]
    ch = sources.config_changes(sources.elements(spark, *changes), schemas.DIM_CONFIG).withColumn("n", F.when(F.col("op") == "d", 9).otherwise(1))
    cfg = config.latest(ch, "n", "source_table")
    assert [r["source_table"] for r in cfg.collect()] == ["base_trademark"]
    e = sources.ods_db(sources.elements(spark, change("base_trademark", "update", 5, {"id": "1", "tm_name": "A", "logo": "u"}), change("other", "insert", 5, {"id": "1"})), None)
    (r,) = config.route_dim(e, cfg).collect()
    assert (r["data"], r["row_key"], r["sink_table"]) == ({"id": "1", "tm_name": "A", "type": "update"}, "1", "dim_base_trademark")
    f = spark.createDataFrame([("base_trademark", "update", "fact", "id")], "source_table string, source_type string, sink_table string, sink_columns string")
    (r,) = config.route_fact(e, f).collect()
    assert (r["topic"], r["data"]) == ("fact", {"id": "1", "ts": "5"})


LOGS = [
    '{"common":{"mid":"m1","uid":"100","vc":"v2","ch":"web","ar":"3","is_new":"1"},"page":{"page_id":"home","during_time":1200},"displays":[{"item":"7"},{"item":"8"}],"actions":[{"action_id":"fav"}],"ts":1718323201000}',
    '{"common":{"mid":"m1","uid":"100","vc":"v2","ch":"web","ar":"3","is_new":"1"},"page":{"page_id":"good_detail","last_page_id":"home","item_type":"keyword","item":"red phone 小米手机","during_time":900},"ts":1718409601000}',
    '{"common":{"mid":"m2","vc":"v2","ch":"app","ar":"3","is_new":"0"},"start":{"entry":"icon"},"err":{"error_code":1},"ts":1718323205000}',
    '{"common":{"mid":"m3"',
]


def test_log_split_and_repair(spark):
    out = {k: v.collect() for k, v in etl.split_log(sources.elements(spark, *LOGS)).items()}
    assert {k: len(v) for k, v in out.items()} == {"dirty": 1, "err": 1, "start": 1, "page": 2, "display": 2, "action": 1}
    assert out["dirty"][0]["value"] == LOGS[3] and out["err"][0]["value"] == LOGS[2]
    assert out["action"][0]["ts"] == 1718323201000 and json.loads(out["display"][0]["display"]) in ({"item": "7"}, {"item": "8"})
    pages = etl.split_log(sources.elements(spark, *LOGS))["page"].select("common.mid", "common.is_new", "ts", F.timestamp_millis("ts").cast("date").alias("d"))
    fixed = etl.repair_visitors(pages, "mid", F.col("d"), "is_new", "ts").orderBy("ts").collect()
    assert [r["is_new"] for r in fixed] == ["1", "0"]


def test_keywords(spark):
    pages = sources.page_log(sources.elements(spark, *LOGS[:3]), None)
    got = text.keywords(text.search_terms(pages)).select("keyword").collect()
    assert sorted(r[0] for r in got) == sorted(["red", "phone", "小米", "手机"])
    assert text.segment(None) == [] and text.segment("A-b1 书") == ["a", "b1", "书"]


def test_snowflake_lets_nulls_through(spark):
    t = lambda cols, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in cols.split()))
    dims = {
        "dim_sku_info": t("id sku_name spu_id category3_id tm_id", ("7", "phone", "70", "c3", "t1")), "dim_spu_info": t("id spu_name", ("70", "phones")), "dim_base_trademark": t("id tm_name", ("t1", "A")),
        "dim_base_category3": t("id name category2_id", ("c3", "three", "c2")), "dim_base_category2": t("id name category1_id", ("c2", "two", "c1")), "dim_base_category1": t("id name", ("c1", "one")),
    }
    rows = {r["sku_id"]: r for r in enrich.sku_snowflake(t("sku_id", ("7",), ("8",)), dims).collect()}
    assert (rows["7"]["spu_name"], rows["7"]["trademark_name"], rows["7"]["category1_name"]) == ("phones", "A", "one")
    assert rows["8"]["sku_name"] is None and rows["8"]["category1_id"] is None
    assert enrich.province(t("province_id", ("3",)), t("id name", ("3", "north"))).first()["province_name"] == "north"


def test_retractions_count_the_last_version_once(spark):
    df = spark.createDataFrame([("1", 1, None, 5), ("1", 2, "9", None), ("2", 1, None, 7)], "id string, v int, activity string, amount long").withColumn("amount", F.col("amount").cast("decimal(16,2)"))
    out = state.retractions(df, "id", (F.asc("v"),), ("amount",))
    assert out.count() == 4
    assert {r["id"]: int(r["s"]) for r in out.groupBy("id").agg(F.sum("amount").alias("s")).collect()} == {"1": 0, "2": 7}


def test_interval_bounds(spark):
    emp = spark.createDataFrame([(1, "ann", 10, 1000)], schemas.EMP)
    dept = spark.createDataFrame([(10, n, t) for n, t in (("a", 995), ("b", 1005), ("c", 994), ("d", 1006))], schemas.DEPT).withColumnsRenamed({"ts": "dts", "deptno": "dno"})
    hit = emp.join(dept, F.expr("deptno = dno and timestamp_millis(ts) between timestamp_millis(dts) - interval 0.005 seconds and timestamp_millis(dts) + interval 0.005 seconds"))
    assert sorted(r["deptname"] for r in hit.collect()) == ["a", "b"]


def test_windows_are_aligned(spark):
    df = spark.createDataFrame([("2024-06-14 00:00:13", None), ("2024-06-14 00:00:20", 3)], "t string, amount long").select(F.to_timestamp("t").alias("et"), F.lit("1").alias("sku_id"), *(F.col("amount").cast("decimal(16,2)").alias(c) for c in windows.SKU_AMOUNTS))
    rows = windows.sku_orders(df).orderBy("stt").collect()
    assert [(r["stt"], r["edt"], r["cur_date"], int(r["order_amount"])) for r in rows] == [("2024-06-14 00:00:10", "2024-06-14 00:00:20", "2024-06-14", 0), ("2024-06-14 00:00:20", "2024-06-14 00:00:30", "2024-06-14", 3)]


def test_dates_and_names(spark):
    r = spark.sql("select '2024-06-14 08:00:01' t").select(dates.text_to_millis("t").alias("ms")).select("ms", dates.millis_to_day("ms").alias("d"), dates.day_before("ms").alias("b"), dates.millis_to_partition("ms").alias("p")).first()
    assert tuple(r) == (1718352001000, "2024-06-14", "2024-06-13", "20240614")
    assert names.to_snake("splitTotalAmount") == "split_total_amount" and names.to_camel("tm_name") == "tmName"
    assert len(str(dates.today())) == 8


def test_other_sources(spark, tmp_path):
    assert sources.csv_topic(sources.elements(spark, "1,ann,10,1000"), "empno int, ename string, deptno int, ts long").first()["ename"] == "ann"
    (tmp_path / "a.txt").write_text('{"page":{"item":"x"},"ts":1000}\n')
    assert sources.page_log(sources.topic(spark, str(tmp_path)), None).first()["page"] == {"item": "x"}
    dim = spark.createDataFrame([("1", "A")], "id string, tm_name string")
    assert sources.lookup(dim, "id", "1").first()["tm_name"] == "A"
    assert sources.fact_topic(sources.elements(spark, '{"id":"1","ts":5}'), schemas.ORDER_DETAIL).first()["id"] == "1"


def test_serving(spark):
    import threading
    import urllib.request

    o = spark.createDataFrame([("2024-06-14", "north", 3.0), ("2024-06-14", "south", 4.0), ("2024-06-15", "north", 9.0)], "cur_date string, province_name string, order_amount double")
    v = spark.createDataFrame([("2024-06-14", f"c{i}", i % 4) for i in range(12)], "cur_date string, ch string, uv_ct long")
    assert json.loads(serving.gmv_json(o, 20240614)) == {"status": 0, "data": 7.0}
    assert json.loads(serving.gmv_json(o, 20200101))["data"] is None
    assert json.loads(serving.province_json(o, 20240614))["data"]["mapData"] == [{"name": "north", "value": 3.0}, {"name": "south", "value": 4.0}]
    assert json.loads(serving.channel_json(v, 20240614, 2))["data"] == {"categories": ["c11", "c3"], "service": [{"name": "visitors", "data": [3, 3]}]}
    s = serving.server(lambda: o, lambda: v)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{s.server_port}"
        assert json.load(urllib.request.urlopen(f"{at}/gmv?date=20240614"))["data"] == 7.0
        assert len(json.load(urllib.request.urlopen(f"{at}/ch?date=20240614"))["data"]["categories"]) == 10
    finally:
        s.shutdown()
