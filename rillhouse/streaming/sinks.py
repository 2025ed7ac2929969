"""Sinks. An upsert table is a folder of versions; a version is complete before it becomes the current one.

A version is a small manifest (bucket, folder): rows are dealt to buckets by their key, a batch rewrites only the
buckets that its keys are in, and the manifest of the next version names the old folders of all others.

Each function that takes (batch, id) is for foreachBatch; batch ids make a repeated batch harmless: it writes the same
version again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.config import route_dim
from ..operators.etl import to_record


MANIFEST = "bucket int, folder string, schema string"
BUCKET = "_bucket"
#: The version of a table that was created before any batch.
BEFORE = -1
#: When a stream looks for new rows, unless a job says otherwise.
EVERY = {"processingTime": "5 seconds"}


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    done = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            done.append(int(name[2:]))
    return sorted(done)


def current(spark: SparkSession, path: str) -> str:
    """Manifest of the newest complete version."""
    v = versions(spark, path)
    if not v:
        raise FileNotFoundError(path)
    return f"{path}/v={v[-1]:012d}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of an upsert table."""
    rows = spark.read.schema(MANIFEST).parquet(current(spark, path)).collect()
    return _read(spark, path, rows)


def _read(spark: SparkSession, path: str, rows: list, buckets: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
    places = [f"{path}/{r['folder']}" for r in rows if r["folder"] and (buckets is None or r["bucket"] in buckets)]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def drop_table(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, path: str, batch_id: int, folders: dict[int, str], schema: T.StructType, keep: int = 2) -> None:
    """Write a version's manifest, then forget all but the newest few (readers may still be on the one before)."""
    text = json.dumps(schema.jsonValue())
    rows = [(k, v, text) for k, v in sorted(folders.items())] or [(-1, "", text)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/v={batch_id:012d}")
    known = versions(spark, path)
    for old in known[:-keep]:
        drop_table(spark, f"{path}/v={old:012d}")
    used = {r[0].split("/")[1] for v in known[-keep:] for r in spark.read.schema(MANIFEST).parquet(f"{path}/v={v:012d}").select("folder").distinct().collect() if r[0]}
    fs, p = _fs(spark, f"{path}/data")
    if fs.exists(p):
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name not in used and int(name[2:]) < known[-1]:
                fs.delete(s.getPath(), True)


def create_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty table, if there is none."""
    if not versions(spark, path):
        publish(spark, path, BEFORE, {}, schema)


def upsert(path: str, key: tuple[str, ...], order: str, deleted: str | None = None, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """Merge by primary key: a batch's last row of a key replaces the old one, or removes it where `deleted` is true.

    buckets: in how many a new table's rows are dealt; a batch reads and writes those that its keys are in.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [v for v in versions(spark, path) if v < batch_id]
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/v={done[-1]:012d}").collect() if done else []
        place = F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in key)), F.lit(buckets)).cast("int")
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").withColumn(BUCKET, place).persist()
        try:
            touched = {r[0] for r in last.select(BUCKET).distinct().collect()}  # at most `buckets` numbers
            rows = last.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else last
            if any(r["bucket"] in touched for r in manifest):
                old = _read(spark, path, manifest, touched).select(*batch.columns).withColumn(BUCKET, place)
                rows = old.join(last.select(*key), list(key), "left_anti").select(*rows.columns).unionByName(rows)
            folder = f"data/b={batch_id:012d}"
            rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/{folder}")
            fs, p = _fs(spark, f"{path}/{folder}")
            written = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()}
            folders = {r["bucket"]: r["folder"] for r in manifest if r["bucket"] >= 0 and r["bucket"] not in touched}
            publish(spark, path, batch_id, folders | {k: f"{folder}/{BUCKET}={k}" for k in written}, batch.schema)
        finally:
            last.unpersist()

    return run


def append(df: DataFrame, path: str, checkpoint: str, *partitions: str, trigger: dict | None = None) -> StreamingQuery:
    """Append-only result table, one folder a day."""
    return df.writeStream.format("parquet").partitionBy(*partitions).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(path)


def topic(df: DataFrame, place: str, checkpoint: str, fmt: str = "text", options: dict[str, str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Rows as JSON strings to one topic."""
    w = to_record(df).writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True}))
    return w.format("kafka").options(topic=place, **(options or {})).start() if fmt == "kafka" else w.format(fmt).start(place)


def routed(df: DataFrame, place: str, checkpoint: str, fmt: str = "text", options: dict[str, str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Rows (topic, data) each to the topic it names."""
    w = df.select("topic", F.to_json("data").alias("value")).writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return w.format("kafka").options(**(options or {})).start() if fmt == "kafka" else w.format(fmt).partitionBy("topic").start(place)


def each(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fan_out(*writers: tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One batch to several outputs: (select, write) pairs over rows that are read once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for select, write in writers:
                write(select(batch), batch_id)
        finally:
            batch.unpersist()

    return run


def json_files(path: str) -> Callable[[DataFrame, int], None]:
    """A batch as JSON lines in a folder of its own, replaced if the batch is repeated."""
    return lambda batch, batch_id: batch.write.mode("overwrite").json(f"{path}/batch={batch_id:012d}")


class DimSink:
    """Changes routed by configuration into dimension tables below `root`: deletes, upserts, cached readers refreshed.

    Configuration is read anew for each batch. Values are strings and empty ones are not stored.
    """

    def __init__(self, root: str, config: Callable[[], DataFrame]):
        self.root, self.config, self.cached = root, config, {}

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        config = self.config()
        rows = route_dim(batch, config).persist()
        try:
            for c in config.select("sink_table", "sink_columns", "sink_row_key").collect():  # one row a table
                mine = rows.where(F.col("sink_table") == c["sink_table"])
                if mine.isEmpty():
                    continue
                names = columns_of(c["sink_columns"])
                flat = mine.select(*(F.nullif(F.col("data")[n], F.lit("")).alias(n) for n in names), F.col("row_key").alias("_key"), (F.col("type") == "delete").alias("_gone"), F.col("ts").alias("_ts"))
                upsert(self.path(c["sink_table"]), ("_key",), "_ts", "_gone")(flat, batch_id)
                if (old := self.cached.get(c["sink_table"])) is not None:
                    old.evict()
        finally:
            rows.unpersist()

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The dimension, kept in memory until a batch changes it."""
        if table not in self.cached:
            self.cached[table] = Kept(lambda: read_table(spark, self.path(table)).drop("_key", "_gone", "_ts"))
        return self.cached[table].read()


class Kept:
    """A table that stays in memory until it is evicted or a day has passed, and is then read anew."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 86_400):
        self.load, self.seconds, self.rows, self.until = load, seconds, None, 0.0

    def read(self) -> DataFrame:
        if self.rows is None or time.monotonic() >= self.until:
            self.evict()
            self.rows, self.until = self.load().persist(), time.monotonic() + self.seconds
        return self.rows

    def evict(self) -> None:
        if self.rows is not None:
            self.rows.unpersist()
            self.rows = None


def columns_of(listed: str) -> list[str]:
    return [x.strip() for x in listed.split(",")]


def apply_config(spark: SparkSession, root: str, changes: DataFrame) -> None:
    """Configuration changes as table changes, in their order: r and c create the sink table, d drops it, u does both."""
    for r in changes.select("op", "before", "after").collect():  # one row a configured table
        old, new = r["before"], r["after"]
        if r["op"] in ("d", "u") and (old or new):
            drop_table(spark, f"{root}/{(old or new)['sink_table']}")
        if r["op"] in ("r", "c", "u") and new:
            names = [*columns_of(new["sink_columns"]), "_key"]
            create_table(spark, f"{root}/{new['sink_table']}", T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_gone", T.BooleanType()), T.StructField("_ts", T.LongType())]))


def supervise(start: Callable[[], StreamingQuery], failures: int = 3, per_seconds: float = 30 * 86_400, delay: float = 3.0) -> StreamingQuery:
    """Run a query to its end; after a failure begin it again from its checkpoint, unless there were too many lately."""
    failed: list[float] = []
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            now = time.monotonic()
            failed = [t for t in failed if now - t < per_seconds] + [now]
            if len(failed) > failures:
                raise
            time.sleep(delay)


def console(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=False)


def as_json(**fields) -> str:
    return json.dumps(fields, ensure_ascii=False, default=float)
