"""Where a program's inputs and outputs are."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import sources
from ..streaming import sinks


@dataclass
class Places:
    """Topics, results, dimensions and checkpoints below one root (topics by name where the format is kafka)."""

    root: str
    fmt: str = "text"
    options: dict[str, str] = field(default_factory=dict)
    trigger: dict | None = None  # None: what there is, then the query ends
    window: str = "10 seconds"

    def topic_name(self, name: str) -> str:
        return name if self.fmt == "kafka" else f"{self.root}/topic/{name}"

    def topic(self, spark: SparkSession, name: str) -> DataFrame:
        return sources.topic(spark, self.topic_name(name), self.fmt, True, self.options)

    def checkpoint(self, job: str) -> str:
        return f"{self.root}/checkpoint/{job}"

    def dim(self, spark: SparkSession, name: str) -> DataFrame:
        return sources.dimension(spark, f"{self.root}/dim/{name}")

    def to_topic(self, df: DataFrame, name: str, job: str) -> StreamingQuery:
        return sinks.topic(df, self.topic_name(name), self.checkpoint(job), self.fmt, self.options, self.trigger)

    def to_table(self, df: DataFrame, name: str, job: str, *key: str) -> StreamingQuery:
        """Facts with a primary key: the last row of a key stays."""
        return sinks.each(df, sinks.upsert(f"{self.root}/fact/{name}", key, "ts"), self.checkpoint(job), self.trigger)

    def to_result(self, df: DataFrame, name: str, job: str) -> StreamingQuery:
        return sinks.append(df, f"{self.root}/result/{name}", self.checkpoint(job), "cur_date", trigger=self.trigger)

    def result(self, spark: SparkSession, name: str, first: str | None = None, last: str | None = None) -> DataFrame:
        return sources.results(spark, f"{self.root}/result/{name}", first, last)
