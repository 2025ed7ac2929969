"""Dates. Strings without a zone are read and written in the session's time zone, which is set once."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, TIME, PARTITION = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd"


def text_to_millis(c: Column | str) -> Column:
    """'yyyy-MM-dd HH:mm:ss' (or a day) to epoch milliseconds."""
    return F.unix_millis(F.to_timestamp(c))


def millis_to_day(c: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(c), DAY)


def millis_to_time(c: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(c), TIME)


def millis_to_partition(c: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(c), PARTITION)


def day_before(c: Column | str) -> Column:
    """The day before the day of epoch milliseconds."""
    return F.date_format(F.date_sub(F.timestamp_millis(c).cast("date"), 1), DAY)


def days_since(now: Column | str, then: Column | str) -> Column:
    return F.datediff(now, then)


def today() -> int:
    """Today as the number yyyyMMdd, the default of the serving queries."""
    return int(datetime.date.today().strftime("%Y%m%d"))
