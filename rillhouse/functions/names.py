"""Column names between snake_case and camelCase."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_camel(name: str) -> str:
    head, *rest = name.lower().split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def to_snake(name: str) -> str:
    return re.sub(r"([A-Z])", r"_\1", name).lower().lstrip("_")


def renamed(df: DataFrame, rule) -> DataFrame:
    return df.toDF(*map(rule, df.columns))


def is_empty(c: Column | str) -> Column:
    """Null and the empty string count alike."""
    return F.coalesce(c, F.lit("")) == ""
