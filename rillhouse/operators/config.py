"""Routing by configuration: rows meet the configuration in a broadcast join, projection is a map filter.

Configuration has one row for each routed table; `checked` bounds it before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .etl import prune, with_operation

#: Rows of configuration up to which it is broadcast; a larger one is joined by a shuffle.
MOST_ROWS = 10_000


def latest(changes: DataFrame, order: str, *key: str) -> DataFrame:
    """The configuration after all changes {op, before, after}: the last one of each key, without deleted ones."""
    row = F.coalesce("after", "before")
    last = changes.select("op", row.alias("row"), order).groupBy(*(F.col("row")[k].alias(f"_{k}") for k in key)).agg(F.max_by(F.struct("op", "row"), order).alias("last"))
    return last.where("last.op <> 'd'").select("last.row.*").withColumn("op", F.lit("r"))


def checked(config: DataFrame) -> DataFrame:
    return F.broadcast(config) if config.limit(MOST_ROWS + 1).count() <= MOST_ROWS else config


def route_dim(changes: DataFrame, config: DataFrame) -> DataFrame:
    """type, data (configured columns and the type), sink_table, sink_row_key, row_key, ts of dimension changes."""
    c = checked(config.select("source_table", "sink_table", "sink_columns", "sink_row_key"))
    out = changes.join(c, changes["table"] == c["source_table"])
    return out.select("type", with_operation(prune(F.col("data"), F.col("sink_columns")), F.col("type")).alias("data"), "sink_table", "sink_row_key", F.col("data")[F.col("sink_row_key")].alias("row_key"), "ts")


def route_fact(changes: DataFrame, config: DataFrame) -> DataFrame:
    """topic, data (configured columns and ts) of changes whose table and type are configured."""
    c = checked(config.select("source_table", "source_type", "sink_table", "sink_columns"))
    out = changes.join(c, (changes["table"] == c["source_table"]) & (changes["type"] == c["source_type"]))
    data = F.map_concat(F.map_filter(prune(F.col("data"), F.col("sink_columns")), lambda k, _: k != "ts"), F.create_map(F.lit("ts"), F.col("ts").cast("string")))
    return out.select(F.col("sink_table").alias("topic"), data.alias("data"))
