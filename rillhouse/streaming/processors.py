"""Stateful processors: the keyed state of the streaming jobs. Time to live is in processing time and optional.

Rows of one micro-batch are put in time order first; across batches a key's rows are taken as they come.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TEXT = T.StructType([T.StructField("value", T.StringType())])


def day_of(ms: int) -> str:
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc).date().isoformat()  # four digits a year, unlike strftime


def in_order(rows: Iterable[Row], time: str) -> list[Row]:
    return sorted(rows, key=lambda r: (r[time] is not None, r[time] or 0))


class _Last(StatefulProcessor):
    """One text value a key."""

    ttl_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", TEXT, self.ttl_ms)

    def get(self) -> str | None:
        return self.last.get()[0] if self.last.exists() else None

    def close(self) -> None:
        pass


class FirstPerDay(_Last):
    """Rows with flag 1 where a key's day (from milliseconds `time`) differs from the last one seen, else 0."""

    def __init__(self, time: str = "ts", ttl_ms: int | None = 86_400_000, only_first: bool = False, flag: str = "uv"):
        self.time, self.ttl_ms, self.only_first, self.flag = time, ttl_ms, only_first, flag

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.get()
        for r in in_order(rows, self.time):
            day = day_of(r[self.time])
            new = day != last
            last = day
            if new or not self.only_first:
                yield Row(**r.asDict(), **{self.flag: int(new)})
        self.last.update((last,))


class ReturningUser(_Last):
    """A user's first row of a day with uu 1 and back 1 if the visit before is `gap` days away or more.

    Rows without a time count as one day of a batch, with back 0, and leave the visit before as it is.
    """

    def __init__(self, time: str = "ts", gap: int = 8, ttl_ms: int | None = 9 * 86_400_000):
        self.time, self.gap, self.ttl_ms = time, gap, ttl_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, timeless = self.get(), False
        for r in in_order(rows, self.time):
            if r[self.time] is None:
                if not timeless:
                    yield Row(**r.asDict(), uu=1, back=0)
                timeless = True
                continue
            day = day_of(r[self.time])
            if day != last:
                away = (datetime.date.fromisoformat(day) - datetime.date.fromisoformat(last)).days if last else 0
                last = day
                yield Row(**r.asDict(), uu=1, back=int(away >= self.gap))
        if last is not None:
            self.last.update((last,))


class Retraction(StatefulProcessor):
    """Each version of a key, preceded by the one before it with its amounts negated."""

    def __init__(self, schema: T.StructType, amounts: tuple[str, ...], ttl_ms: int | None = 10_000):
        self.schema, self.ttl_ms = schema, ttl_ms
        self.at = [schema.fieldNames().index(a) for a in amounts]

    def row(self, values) -> Row:
        return Row(**dict(zip(self.schema.fieldNames(), values, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("version", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else None
        for r in rows:
            now = [0 if i in self.at and v is None else v for i, v in enumerate(r)]
            if last is not None:
                yield self.row([-v if i in self.at else v for i, v in enumerate(last)])
            last = tuple(now)
            yield self.row(now)
        self.last.update(last)

    def close(self) -> None:
        pass


class LatestAfter(StatefulProcessor):
    """The last version of a key, given out by a timer `wait_ms` after its first one."""

    def __init__(self, schema: T.StructType, wait_ms: int = 5_000):
        self.schema, self.wait_ms = schema, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("version", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = not self.last.exists()
        for r in rows:
            self.last.update(tuple(r))
        if fresh:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            r = Row(**dict(zip(self.schema.fieldNames(), tuple(self.last.get()), strict=True)))
            self.last.clear()
            yield r

    def close(self) -> None:
        pass


class VisitorRepair(_Last):
    """Rows with the new-visitor flag at `flag` repaired by the day of the first visit; rows without a time pass."""

    def __init__(self, schema: T.StructType, flag: str = "is_new", time: str = "ts"):
        self.time, self.flag, self.schema = time, flag, schema

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = self.get()
        for r in in_order(rows, self.time):
            if r[self.time] is None:
                yield r
                continue
            day, values = day_of(r[self.time]), r.asDict()
            if values[self.flag] == "1":
                if first is None:
                    first = day
                elif first != day:
                    values[self.flag] = "0"
            elif first is None:
                first = day_of(r[self.time] - 86_400_000)
            yield Row(**values)
        if first is not None:
            self.last.update((first,))


def with_state(df: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType, time_mode: str = "ProcessingTime", event_time: str = "") -> DataFrame:
    """The processor over a stream (or, with time_mode 'None', a batch) keyed by a column.

    event_time names the column of the result whose watermark a window downstream goes by. Executors look for the state
    stores' coordinator on the driver even in a batch; a session starts it with its stream manager, so that is asked for.
    """
    df.sparkSession.streams  # noqa: B018
    return df.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode, eventTimeColumnName=event_time)


def plus(schema: T.StructType, *flags: str) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(f, T.LongType()) for f in flags)])
