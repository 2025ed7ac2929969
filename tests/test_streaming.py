"""Streams against batches over the same input, sinks, and recovery."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillhouse import schemas, sources
from rillhouse.operators import etl, facts, state, windows
from rillhouse.streaming import processors as P
from rillhouse.streaming import sinks

from .test_fixtures import DB, T0, change, dic

DAY = 86_400_000
EVENTS = T.StructType([T.StructField("uid", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("is_new", T.StringType())])


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in lines))


def collect(df, spark, tmp_path, name, rows=1, seconds=60):
    """Run until the input is used up: state with processing time never lets a query end by itself."""
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        until = time.time() + seconds
        while time.time() < until and spark.table(name).count() < rows:
            assert not q.awaitTermination(1)
        q.awaitTermination(2)
    finally:
        q.stop()
    return spark.table(name).collect()


def visits():
    out = []
    for k, u in enumerate(("a", "b", "c")):
        for d in (0, 0, 1, 2 + k, 12, 12, 25):
            out.append((u, T0 * 1000 + d * DAY + k, "1" if d % 2 == 0 else "0"))
    return out


@pytest.fixture
def stream(spark, tmp_path):
    put(tmp_path / "in", "a.json", [json.dumps(dict(zip(("uid", "ts", "is_new"), v, strict=True))) for v in visits()])
    return spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))


def test_first_per_day(spark, tmp_path, stream):
    got = collect(P.with_state(stream, "uid", P.FirstPerDay(), P.plus(EVENTS, "uv")), spark, tmp_path, "first", len(visits()))
    batch = state.first_per_day(spark.createDataFrame(visits(), EVENTS), F.timestamp_millis("ts").cast("date"), "uid", order=("ts",))
    assert sum(r["uv"] for r in got) == batch.agg(F.sum("uv")).first()[0] and len(got) == len(visits())
    only = P.with_state(spark.createDataFrame(visits(), EVENTS), "uid", P.FirstPerDay(ttl_ms=None, only_first=True), P.plus(EVENTS, "uv"), "None")
    assert only.count() == sum(r["uv"] for r in got)


def test_returning_users(spark, tmp_path, stream):
    got = collect(P.with_state(stream, "uid", P.ReturningUser(), P.plus(EVENTS, "uu", "back")), spark, tmp_path, "back")
    batch = state.returning_users(spark.createDataFrame(visits(), EVENTS), "uid", F.timestamp_millis("ts").cast("date")).agg(F.sum("uu"), F.sum("back")).first()
    assert (sum(r["uu"] for r in got), sum(r["back"] for r in got)) == tuple(batch)


def test_visitor_repair(spark, tmp_path, stream):
    got = collect(P.with_state(stream, "uid", P.VisitorRepair(EVENTS), EVENTS), spark, tmp_path, "repair", len(visits()))
    batch = etl.repair_visitors(spark.createDataFrame(visits(), EVENTS), "uid", F.timestamp_millis("ts").cast("date"), "is_new", "ts")
    key = lambda r: (r["uid"], r["ts"], r["is_new"])
    assert sorted(map(key, got)) == sorted(map(key, batch.collect()))


def test_retraction_and_timer(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("amount", T.LongType())])
    put(tmp_path / "v", "a.json", ['{"id":"1","amount":5}', '{"id":"2","amount":7}'])
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "v"))
    put(tmp_path / "v", "b.json", ['{"id":"1","amount":null}'])
    got = collect(P.with_state(df, "id", P.Retraction(schema, ("amount",), None), schema, "None"), spark, tmp_path, "undo", 4)
    assert sum(r["amount"] for r in got if r["id"] == "1") in (0, 5) and len(got) == 4
    timed = P.with_state(df, "id", P.LatestAfter(schema, 0), schema)
    q = timed.writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "cp-t")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            q.awaitTermination(1)
            if spark.table("timed").count() >= 2:
                break
    finally:
        q.stop()
    assert {r["id"] for r in spark.table("timed").collect()} == {"1", "2"}


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = [{"id": str(i), "order_id": str(i % 5), "province_id": str(i % 2), "amount": 1.5, "ts": T0 + i} for i in range(60)]
    closing = {"id": "x", "order_id": "x", "province_id": "x", "amount": 0, "ts": T0 + 10_000}
    put(tmp_path / "o", "a.json", map(json.dumps, rows))
    put(tmp_path / "o", "b.json", [json.dumps(closing)])
    schema = "id string, order_id string, province_id string, amount decimal(16,2), ts long"
    ready = lambda d: d.select("order_id", "province_id", F.col("amount").alias("order_amount"), F.timestamp_seconds("ts").alias("et"))
    s = ready(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "o"))).withWatermark("et", "0 seconds")
    got = collect(windows.province_orders(s, streaming=True), spark, tmp_path, "prov", 12)
    want = windows.province_orders(ready(spark.read.schema(schema).json(str(tmp_path / "o")))).where("province_id <> 'x'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "t timestamp, keyword string"
    (tmp_path / "l").mkdir()
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "l"))
    put(tmp_path / "l", "a.json", ['{"t":"2024-01-01T00:01:00Z","keyword":"a"}'])
    q = windows.keywords(df.withWatermark("t", "0 seconds"), "t").writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    put(tmp_path / "l", "b.json", ['{"t":"2024-01-01T00:00:01Z","keyword":"late"}', '{"t":"2024-01-01T01:00:00Z","keyword":"b"}'])
    q.processAllAvailable()
    q.stop()
    assert [r["keyword"] for r in spark.table("late").collect()] == ["a"]


def test_streaming_facts_and_topic_sinks(spark, tmp_path):
    put(tmp_path / "db", "a.txt", DB)
    put(tmp_path / "db", "z.txt", [change("order_detail", "insert", T0 + 90_000, {"id": "99"}), change("payment_info", "update", T0 + 90_000, {"order_id": "z", "payment_status": "1602"}, {"payment_status": "0"})])
    db = sources.ods_db(sources.topic(spark, str(tmp_path / "db"), streaming=True))
    cart = sinks.topic(facts.cart_add(db), str(tmp_path / "cart"), str(tmp_path / "cp1"))
    cart.awaitTermination()
    assert spark.read.text(str(tmp_path / "cart")).count() == 2
    detail = facts.order_detail(db.where("table = 'order_detail' or table = 'order_info'"), "shop")
    one = db.where("table = 'payment_info'")
    d = db.where("table = 'order_detail'").select(F.col("data")["order_id"].alias("order_id"), F.col("data")["id"].alias("id"), *(F.lit(None).cast("string").alias(c) for c in ("user_id", "sku_id", "sku_name", "province_id", "activity_id", "activity_rule_id", "coupon_id", "sku_num", "split_original_amount", "split_activity_amount", "split_coupon_amount", "split_total_amount")), "et")
    got = collect(facts.payment_success(d, one, dic(spark)), spark, tmp_path, "paid")
    assert [r["order_detail_id"] for r in got] == ["1"] and detail.isStreaming


def test_routed_topics(spark, tmp_path):
    df = spark.createDataFrame([("t1", {"id": "1"}), ("t2", {"id": "2"})], "topic string, data map<string,string>")
    df.write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))
    sinks.routed(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.text(str(tmp_path / "out")).collect()
    assert {(r["topic"], r["value"]) for r in rows} == {("t1", '{"id":"1"}'), ("t2", '{"id":"2"}')}


def test_upsert_and_repeated_batches(spark, tmp_path):
    path, schema = str(tmp_path / "up"), "id string, v string, ts long, gone boolean"
    write = sinks.upsert(path, ("id",), "ts", "gone")
    write(spark.createDataFrame([("1", "a", 1, False), ("1", "b", 2, False), ("2", "c", 1, False)], schema), 0)
    second = spark.createDataFrame([("2", None, 3, True), ("3", "d", 3, False)], schema)
    for _ in range(2):  # a batch that is repeated after a failure
        write(second, 1)
    assert sorted((r["id"], r["v"]) for r in sinks.read_table(spark, path).collect()) == [("1", "b"), ("3", "d")]
    write(spark.createDataFrame([("1", "z", 9, False)], schema), 2)
    assert len(sinks.versions(spark, path)) == 2
    folders = lambda v: {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{path}/v={v:012d}").collect()}
    before, after = folders(1), folders(2)
    assert sum(before.get(k) != f for k, f in after.items()) == 1  # one key, one bucket
    for i in range(3, 7):
        write(spark.createDataFrame([(str(10 + i), "n", 9, False)], schema), i)
    assert sorted(r["id"] for r in sinks.read_table(spark, path).collect()) == ["1", "13", "14", "15", "16", "3"]


def test_config_creates_and_drops_tables(spark, tmp_path):
    one = ("base_trademark", "dim_tm", "id, tm_name", "i", "id", "r")
    kind = schemas.config_change(schemas.DIM_CONFIG)
    apply = lambda *rows: sinks.apply_config(spark, str(tmp_path / "d"), spark.createDataFrame(list(rows), kind))
    apply(("r", None, one))
    table = sources.dimension(spark, str(tmp_path / "d" / "dim_tm"))
    assert table.columns[:2] == ["id", "tm_name"] and table.count() == 0
    sink = sinks.DimSink(str(tmp_path / "d"), lambda: spark.createDataFrame([one], schemas.DIM_CONFIG))
    rows = [("base_trademark", "insert", {"id": "1", "tm_name": "A"}, 1)]
    sink(spark.createDataFrame(rows, "table string, type string, data map<string,string>, ts long"), 0)
    assert [tuple(r) for r in sink.read(spark, "dim_tm").collect()] == [("1", "A")]
    apply(("u", one, (*one[:2], "id", *one[3:])))
    assert sources.dimension(spark, str(tmp_path / "d" / "dim_tm")).columns[0] == "id" and sources.dimension(spark, str(tmp_path / "d" / "dim_tm")).count() == 0


def test_cache_expires(spark):
    reads = []
    kept = sinks.Kept(lambda: reads.append(1) or spark.range(1), seconds=0.2)
    kept.read(), kept.read()
    assert len(reads) == 1
    time.sleep(0.3)
    kept.read()
    kept.evict()
    assert kept.read().count() == 1 and len(reads) == 3


def test_supervisor_starts_again(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "s"))
    tries = []

    def start():
        def write(batch, _):
            tries.append(batch.count())
            if len(tries) < 3:
                raise RuntimeError("lost")

        return sinks.each(spark.readStream.schema("id long").parquet(str(tmp_path / "s")), write, str(tmp_path / "c"))

    sinks.supervise(start, delay=0)
    assert tries == [3, 3, 3]


def test_dim_sink_refreshes_readers(spark, tmp_path):
    put(tmp_path / "db", "a.txt", [change("base_trademark", "bootstrap-insert", 1, {"id": "1", "tm_name": "A", "x": "y"}), change("base_trademark", "insert", 2, {"id": "2", "tm_name": "", "x": "y"})])
    cfg = spark.createDataFrame([("base_trademark", "dim_base_trademark", "id,tm_name", "info", "id", "r")], schemas.DIM_CONFIG)
    sink = sinks.DimSink(str(tmp_path / "dims"), lambda: cfg)

    def run():
        db = etl.dim_changes(sources.ods_db(sources.topic(spark, str(tmp_path / "db"), streaming=True), None), "shop")
        sinks.each(db, sink, str(tmp_path / "cp")).awaitTermination()
        return sorted(map(tuple, sink.read(spark, "dim_base_trademark").collect()))

    assert run() == [("1", "A"), ("2", None)]
    put(tmp_path / "db", "b.txt", [change("base_trademark", "update", 3, {"id": "2", "tm_name": "B"}), change("base_trademark", "delete", 4, {"id": "1"})])
    assert run() == [("2", "B")]  # restarted from its checkpoint, it reads only what is new
    assert sources.dimension(spark, sink.path("dim_base_trademark")).count() == 1
    ch = spark.createDataFrame([("d", ("base_trademark", "dim_base_trademark", "id", "i", "id", "d"), None)], schemas.config_change(schemas.DIM_CONFIG))
    sinks.apply_config(spark, str(tmp_path / "dims"), ch)
    assert sinks.versions(spark, sink.path("dim_base_trademark")) == []


def test_append_by_day_and_fan_out(spark, tmp_path):
    df = spark.createDataFrame([("2024-06-14", 1), ("2024-06-15", 2)], "cur_date string, n int")
    df.write.parquet(str(tmp_path / "src"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    sinks.append(s, str(tmp_path / "res"), str(tmp_path / "cp"), "cur_date").awaitTermination()
    one = spark.read.parquet(str(tmp_path / "res")).where("cast(cur_date as string) = '2024-06-14'")
    assert one.count() == 1
    fan = sinks.fan_out((lambda b: b.where("n = 1"), sinks.json_files(str(tmp_path / "a"))), (lambda b: b.where("n > 1"), sinks.json_files(str(tmp_path / "b"))))
    sinks.each(s, fan, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "a")).count() == spark.read.json(str(tmp_path / "b")).count() == 1
