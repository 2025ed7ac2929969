"""The programs end to end: topics in, tables and results out, each held against a batch over the same rows."""

import json
import os
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from rillhouse import jobs, schemas, sources
from rillhouse.operators import etl, windows

from .test_fixtures import T0

GMALL = "gmall"


def put(place, lines, name="a.txt"):
    os.makedirs(place, exist_ok=True)
    with open(f"{place}/{name}", "w", encoding="utf-8") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)


def change(table, kind, ts, data, old=None):
    return {"database": GMALL, "table": table, "type": kind, "ts": ts, "data": data, "old": old}


@pytest.fixture
def places(tmp_path):
    return jobs.Places(str(tmp_path / "w"))


def once(spark, places, name):
    q = jobs.run(name, spark, places)
    try:
        assert q.awaitTermination(60), name
    finally:
        q.stop()


def test_programs():
    assert len(jobs.PROGRAMS) == 19  # the dimension program is two: its tables, and their rows


def test_dim_follows_its_configuration(spark, places):
    cfg = {"source_table": "base_trademark", "sink_table": "dim_base_trademark", "sink_columns": "id,tm_name", "sink_family": "info", "sink_row_key": "id"}
    put(places.topic_name("table_process_dim"), [{"op": "r", "before": None, "after": cfg, "ts_ms": 1}])
    put(places.topic_name("topic_db"), [change("base_trademark", "bootstrap-insert", 1, {"id": "1", "tm_name": "A", "logo": "x"}), change("base_trademark", "insert", 2, {"id": "2", "tm_name": "B"}), change("other", "insert", 2, {"id": "3"})])
    once(spark, places, "dim_tables")
    assert places.dim(spark, "dim_base_trademark").count() == 0
    once(spark, places, "dim")
    read = lambda: sorted((r["id"], r["tm_name"]) for r in places.dim(spark, "dim_base_trademark").collect())
    assert read() == [("1", "A"), ("2", "B")]
    put(places.topic_name("topic_db"), [change("base_trademark", "update", 3, {"id": "2", "tm_name": "C"}, {"tm_name": "B"}), change("base_trademark", "delete", 4, {"id": "1"})], "b.txt")
    once(spark, places, "dim")
    assert read() == [("2", "C")]
    put(places.topic_name("table_process_dim"), [{"op": "d", "before": cfg, "after": None, "ts_ms": 2}], "b.txt")
    once(spark, places, "dim_tables")
    with pytest.raises(FileNotFoundError):
        places.dim(spark, "dim_base_trademark")


def test_routed_facts(spark, places):
    cfg = {"source_table": "coupon_use", "source_type": "insert", "sink_table": "dwd_coupon_get", "sink_columns": "id,coupon_id"}
    put(places.topic_name("table_process_dwd"), [{"op": "r", "before": None, "after": cfg}])
    put(places.topic_name("topic_db"), [change("coupon_use", "insert", 7, {"id": "1", "coupon_id": "9", "x": "y"}), change("coupon_use", "bootstrap-insert", 7, {"id": "2"}), change("coupon_use", "update", 7, {"id": "3"})])
    once(spark, places, "dwd_base_db")
    rows = spark.read.text(f"{places.root}/topic/routed").collect()
    assert [(r["topic"], json.loads(r["value"])) for r in rows] == [("dwd_coupon_get", {"id": "1", "coupon_id": "9", "ts": "7"})]


def logs():
    day = 86_400_000
    common = lambda mid, new: {"mid": mid, "uid": "u" + mid, "vc": "v1", "ch": "web", "ar": "1", "is_new": new}
    out = []
    for mid in ("a", "b", "c"):
        for d, new in ((0, "1"), (0, "1"), (1, "1"), (2, "0")):
            out.append({"common": common(mid, new), "page": {"page_id": "home" if d else "login", "last_page_id": "search", "during_time": 100 + d}, "displays": [{"item": "1"}, {"item": "2"}], "actions": [{"action_id": "fav"}], "ts": T0 * 1000 + d * day + len(out)})
    out.append({"common": common("d", "0"), "start": {"entry": "icon"}, "err": {"error_code": 1}, "ts": T0 * 1000})
    return out


def test_log_split_end_to_end_equals_batch(spark, places):
    lines = [json.dumps(x) for x in logs()] + ['{"common":{"mid":"m3"']
    put(places.topic_name("topic_log"), lines)
    once(spark, places, "dwd_base_log")
    batch = etl.parsed_log(sources.elements(spark, *lines)).withColumns({"is_new": F.col("common.is_new"), "mid": F.col("common.mid")})
    day = F.timestamp_millis("ts").cast("date")
    want = etl.split_parsed(etl.with_flag(etl.repair_visitors(batch, "mid", day, "is_new", "ts")))
    for name, df in want.items():
        rows = sorted(r[0] for r in spark.read.text(places.topic_name(f"dwd_traffic_{name}")).select("value").collect())
        expected = sorted(r[0] for r in (df if df.columns == ["value"] else etl.to_record(df)).collect())
        assert rows == expected and rows, name
    pages = [json.loads(r[0]) for r in spark.read.text(places.topic_name("dwd_traffic_page")).select("value").collect()]
    assert sorted(p["common"]["is_new"] for p in pages) == ["0"] * 6 + ["1"] * 6
    tagged = {r["branch"]: r["count"] for r in etl.tag_log(sources.elements(spark, *lines)).groupBy("branch").count().collect()}
    assert tagged == {k: v.count() for k, v in want.items()}


def order_line(i, order, province, amount, ts, sku="1"):
    return {"id": i, "order_id": order, "sku_id": sku, "province_id": province, "split_original_amount": amount, "split_activity_amount": "1.00", "split_coupon_amount": None, "split_total_amount": amount, "ts": ts}


def dim_table(spark, places, name, rows):
    spark.createDataFrame(rows[1:], [*rows[0]]).createOrReplaceTempView("d")
    names = rows[0]
    from rillhouse.streaming import sinks

    df = spark.sql(f"select {', '.join(f'cast({n} as string) as {n}' for n in names)}, cast({names[0]} as string) as _key, false as _gone, 1L as _ts from d")
    sinks.upsert(f"{places.root}/dim/{name}", ("_key",), "_ts", "_gone")(df, 0)


def test_province_chain_equals_batch(spark, places):
    rows = [order_line("1", "o1", "1", "10.00", T0), order_line("2", "o1", "1", "5.00", T0 + 1), order_line("3", "o2", "2", "7.50", T0 + 2), order_line("4", "o3", "9", "1.00", T0 + 11)]
    late = [order_line("end", "o9", "1", "0.00", T0 + 9000)]
    put(places.topic_name("dwd_trade_order_detail"), rows)
    dim_table(spark, places, "dim_base_province", [("id", "name"), ("1", "North"), ("2", "South")])
    for name, line in (("a.txt", rows), ("b.txt", late), ("c.txt", late)):
        put(places.topic_name("dwd_trade_order_detail"), line, name)
        once(spark, places, "dws_trade_province_order_window")
    got = {(r["stt"], r["province_name"]): (r["order_count"], float(r["order_amount"])) for r in places.result(spark, "dws_trade_province_order_window", "2024-06-14", "2024-06-14").collect()}
    batch = sources.fact_topic(sources.elements(spark, *map(json.dumps, rows)), schemas.ORDER_DETAIL).withColumn("order_amount", F.col("split_total_amount").cast(schemas.MONEY))
    want = {(r["stt"], {"1": "North", "2": "South"}.get(r["province_id"])): (r["order_count"], float(r["order_amount"])) for r in windows.province_orders(batch, "et").collect()}
    assert {k: v for k, v in got.items() if k in want} == want and len(want) == 3


def test_sku_chain_retracts_older_versions(spark, places):
    put(places.topic_name("dwd_trade_order_detail"), [order_line("1", "o1", "1", "10.00", T0, "s1"), order_line("1", "o1", "1", "10.00", T0, "s1"), order_line("2", "o1", "1", "2.50", T0, "s1")])
    for name in ("dim_sku_info", "dim_spu_info", "dim_base_trademark", "dim_base_category3", "dim_base_category2", "dim_base_category1"):
        cols = {"dim_sku_info": ("id", "sku_name", "spu_id", "category3_id", "tm_id"), "dim_spu_info": ("id", "spu_name"), "dim_base_trademark": ("id", "tm_name"), "dim_base_category3": ("id", "name", "category2_id"), "dim_base_category2": ("id", "name", "category1_id"), "dim_base_category1": ("id", "name")}[name]
        dim_table(spark, places, name, [cols, ("s1" if name == "dim_sku_info" else "1", *["1"] * (len(cols) - 1))])
    once(spark, places, "dws_trade_sku_order_window")
    for name in ("b.txt", "c.txt"):
        put(places.topic_name("dwd_trade_order_detail"), [order_line("end" + name, "o9", "1", "0.00", T0 + 9000, "s9")], name)
        once(spark, places, "dws_trade_sku_order_window")
    rows = [r for r in places.result(spark, "dws_trade_sku_order_window").collect() if r["sku_id"] == "s1"]
    assert [(float(r["order_amount"]), float(r["coupon_reduce_amount"]), r["trademark_name"], r["category1_name"]) for r in rows] == [(12.5, 0.0, "1", "1")]


def test_page_programs_and_serving(spark, places):
    pages = [x for x in logs() if "page" in x]
    for x in pages:
        x["page"]["last_page_id"] = "login" if x["page"]["page_id"] == "home" else None
    pages.append({"common": {"mid": "s"}, "page": {"page_id": "list", "last_page_id": "search", "item_type": "keyword", "item": "red phone"}, "ts": T0 * 1000})
    end = {"common": {"mid": "z", "uid": "z"}, "page": {"page_id": "home"}, "ts": (T0 + 9 * 86_400) * 1000}
    search = end | {"page": {"page_id": "list", "last_page_id": "search", "item_type": "keyword", "item": "later"}}
    names = [n for n in jobs.PROGRAMS if n.startswith("dws_") and ("traffic" in n or "login" in n)]
    for file, lines in (("a.txt", pages), ("b.txt", [end, search]), ("c.txt", [end, search])):
        put(places.topic_name("dwd_traffic_page"), lines, file)
        for n in names:
            once(spark, places, n)
    day = "2024-06-14"
    view = places.result(spark, "dws_traffic_vc_ch_ar_is_new_page_view_window", day, day).where("ch = 'web'").agg(F.sum("uv_ct"), F.sum("pv_ct"), F.sum("sv_ct")).first()
    assert tuple(view) == (3, 6, 6)
    assert {r["keyword"] for r in places.result(spark, "dws_traffic_source_keyword_page_view_window").collect()} == {"red", "phone"}
    assert places.result(spark, "dws_traffic_home_detail_page_view_window").agg(F.sum("home_uv_ct")).first()[0] >= 6
    assert places.result(spark, "dws_user_user_login_window").agg(F.sum("uu_ct")).first()[0] >= 6
    spark.createDataFrame([("1", "North", 12.5, day)], "province_id string, province_name string, order_amount double, cur_date string").write.partitionBy("cur_date").parquet(f"{places.root}/result/dws_trade_province_order_window")
    server = jobs.run("serving_http", spark, places)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        get = lambda path: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}").read())
        assert get("/gmv?date=20240614")["data"] == 12.5
        assert get("/province?date=20240614")["data"]["mapData"] == [{"name": "North", "value": 12.5}]
        assert get("/ch?date=20240614&limit=3")["data"]["categories"][0] == "web"
    finally:
        server.shutdown()
    plan = places.result(spark, "dws_trade_province_order_window", day, day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cur_date" in plan


def test_fact_programs(spark, places):
    dim_table(spark, places, "dim_base_dic", [("dic_code", "dic_name"), ("1201", "good")])
    put(places.topic_name("topic_db"), [change("cart_info", "insert", T0, {"id": "1", "user_id": "7", "sku_id": "3", "sku_num": "2"}), change("comment_info", "insert", T0, {"id": "1", "user_id": "7", "sku_id": "3", "appraise": "1201", "comment_txt": "ok"})])
    once(spark, places, "dwd_trade_cart_add")
    once(spark, places, "dwd_interaction_comment_info")
    read = lambda n: [json.loads(r[0]) for r in spark.read.text(places.topic_name(n)).collect()]
    assert [(x["user_id"], x["sku_num"]) for x in read("dwd_trade_cart_add")] == [("7", "2")]
    assert [x["appraise_name"] for x in read("dwd_interaction_comment_info")] == ["good"]
    once(spark, places, "dws_trade_cart_add_uu_window")
    for n in ("dwd_trade_order_detail", "dwd_trade_order_refund", "dwd_trade_refund_pay_suc_detail"):
        once(spark, places, n)
