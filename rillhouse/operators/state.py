"""Keyed state in batch form: window functions in place of stored values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_day(df: DataFrame, day: Column, *key: str, order: tuple = (), flag: str = "uv") -> DataFrame:
    """df with flag 1 on the first row of a key and day, else 0."""
    w = Window.partitionBy(*key, day).orderBy(*order)
    return df.withColumn(flag, (F.row_number().over(w) == 1).cast("long"))


def returning_users(df: DataFrame, user: str, day: Column, gap: int = 8) -> DataFrame:
    """user, day, uu (1), back (1 if the visit before is `gap` days away or more): one row a user and day."""
    days = df.select(F.col(user), day.alias("day")).distinct()
    last = F.lag("day").over(Window.partitionBy(user).orderBy("day"))
    return days.select(user, "day", F.lit(1).cast("long").alias("uu"), F.coalesce((F.datediff("day", last) >= gap).cast("long"), F.lit(0).cast("long")).alias("back"))


def latest_version(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last version of each key; order by columns that leave no ties."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def retractions(df: DataFrame, key: str, order: tuple, amounts: tuple[str, ...]) -> DataFrame:
    """Each version of a key, preceded by the version before it with negated amounts: sums then count the last only."""
    w = Window.partitionBy(key).orderBy(*order)
    more = df.select("*", *(F.lag(F.coalesce(a, F.lit(0))).over(w).alias(f"_{a}") for a in amounts), (F.row_number().over(w) > 1).alias("_again"))
    undo = more.where("_again").select(*(c if c not in amounts else (-F.col(f"_{c}")).cast(df.schema[c].dataType).alias(c) for c in df.columns))
    return df.withColumns({a: F.coalesce(a, F.lit(0)).cast(df.schema[a].dataType) for a in amounts}).unionByName(undo)
