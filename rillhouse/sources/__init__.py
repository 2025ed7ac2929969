"""Sources. Each returns a DataFrame, bounded or streaming; the format is configuration, the rest of a plan is the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def topic(spark: SparkSession, place: str, fmt: str = "text", streaming: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """An append log of JSON strings as one column `value`; null values (tombstones) are left out.

    fmt `kafka` reads the topic `place` from its latest offset (the connector comes with the cluster); any file format
    reads a folder that producers add files to.
    """
    reader = spark.readStream if streaming else spark.read
    if fmt == "kafka":
        start = {"startingOffsets": "latest"} if streaming else {}
        raw = reader.format("kafka").options(subscribe=place, **start, **(options or {})).load().select(F.col("value").cast("string").alias("value"), "timestamp")
    else:
        raw = reader.format(fmt).options(**(options or {})).schema("value string").load(place)
    return raw.where(F.col("value").isNotNull())


def from_json(df: DataFrame, schema: T.DataType, strict: bool = False) -> DataFrame:
    """The fields of the JSON in `value`; strict fails on malformed text, otherwise its fields are null."""
    return df.select(F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("r.*")


def ods_db(df: DataFrame, delay: str | None = "3 seconds") -> DataFrame:
    """Change envelopes with processing time pt, event time et (ts is in seconds) and a watermark."""
    out = from_json(df, schemas.ENVELOPE).withColumn("pt", F.current_timestamp()).withColumn("et", F.timestamp_seconds("ts"))
    return out.withWatermark("et", delay) if delay else out


def page_log(df: DataFrame, delay: str | None = "5 seconds") -> DataFrame:
    """Page logs: the page as a map, et from milliseconds."""
    out = from_json(df, schemas.PAGE_LOG).withColumn("et", F.timestamp_millis("ts"))
    return out.withWatermark("et", delay) if delay else out


def fact_topic(df: DataFrame, schema: T.StructType, delay: str | None = None) -> DataFrame:
    """A fact topic read again as a source, with a watermark on its seconds if asked for."""
    out = from_json(df, schema).withColumn("et", F.timestamp_seconds("ts"))
    return out.withWatermark("et", delay) if delay else out


def config_changes(df: DataFrame, config: T.StructType) -> DataFrame:
    """Configuration changes {op, before, after}; rows of a snapshot have op r."""
    return from_json(df, schemas.config_change(config))


def jdbc(spark: SparkSession, url: str, name: str, rename: Callable[[str], str] | None = None, **options: str) -> DataFrame:
    """A whole table of a database; rename maps its column names."""
    df = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return df.toDF(*map(rename, df.columns)) if rename else df


def dimension(spark: SparkSession, path: str) -> DataFrame:
    """A dimension table as its sink writes it: strings, newest version."""
    from ..streaming.sinks import read_table

    return read_table(spark, path)


def results(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A result table as its sink appends it; of the days from first to last (yyyy-MM-dd) no other folder is read."""
    out = spark.read.option("recursiveFileLookup", "false").parquet(path).withColumn("cur_date", F.col("cur_date").cast("string"))
    return out.where((F.col("cur_date") >= (first or "")) & (F.col("cur_date") <= (last or "9")))


def lookup(dim: DataFrame, key: str, value: str) -> DataFrame | None:
    """Point read of a dimension row."""
    return dim.where(F.col(key) == value)


def csv_topic(df: DataFrame, schema: str, timestamp: str | None = None) -> DataFrame:
    """A topic of CSV lines; the broker's timestamp column can be the event time."""
    out = df.select(F.from_csv("value", schema).alias("r"), *([timestamp] if timestamp else []))
    return out.select("r.*", *([timestamp] if timestamp else []))


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket; for trials."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def elements(spark: SparkSession, *values: str) -> DataFrame:
    """Rows given in code, as a topic."""
    return spark.createDataFrame([(v,) for v in values], "value string")
