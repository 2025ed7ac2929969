"""Cleaning and splitting of change envelopes and behaviour logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

#: Change types that carry a dimension row (fixed values of the envelope).
DIM_TYPES = ("insert", "update", "delete", "bootstrap-insert")


def dim_changes(df: DataFrame, source_db: str) -> DataFrame:
    """Changes of one database with a row in them."""
    return df.where((F.col("database") == source_db) & F.col("type").isin(*DIM_TYPES) & (F.size("data") > 0))


def live_changes(df: DataFrame) -> DataFrame:
    """Changes that are not part of a bootstrap."""
    return df.where(~F.startswith("type", F.lit("bootstrap-")))


def split_dirty(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed, malformed) JSON strings."""
    bad = F.col("value").isNotNull() & F.try_parse_json("value").isNull()
    return df.where(F.col("value").isNotNull() & ~bad), df.where(bad)


def prune(data: Column, keep: Column) -> Column:
    """The entries of a map whose keys are in the comma-separated list."""
    names = F.transform(F.split(keep, ","), lambda x: F.trim(x))
    return F.map_filter(data, lambda k, _: F.array_contains(names, k))


def with_operation(data: Column, kind: Column) -> Column:
    """The map with the change's type in it."""
    return F.map_concat(F.map_filter(data, lambda k, _: k != "type"), F.create_map(F.lit("type"), kind))


def rows_of(df: DataFrame, table: str, kinds: tuple[str, ...] = ("insert",), source_db: str | None = None) -> DataFrame:
    """Changes of one logical table."""
    where = (F.col("table") == table) & F.col("type").isin(*kinds)
    return df.where(where & (F.col("database") == source_db) if source_db else where)


def fields(df: DataFrame, *names: str, more: tuple[str, ...] = ("ts",), **renamed: str) -> DataFrame:
    """Columns from the map `data`: names as they are, renamed as new=old; `more` are kept from the envelope."""
    return df.select(*(F.col("data")[n].alias(n) for n in names), *(F.col("data")[o].alias(n) for n, o in renamed.items()), *more)


def became(df: DataFrame, field: str, value: str) -> DataFrame:
    """Updates that changed a field to a value."""
    return df.where((F.col("type") == "update") & F.col("old")[field].isNotNull() & (F.col("data")[field] == value))


def moved(df: DataFrame, field: str, before: str, after: str) -> DataFrame:
    """Updates that changed a field from one value to another."""
    return df.where((F.col("type") == "update") & (F.col("old")[field] == before) & (F.col("data")[field] == after))


def cart_additions(df: DataFrame) -> DataFrame:
    """id, user_id, sku_id, sku_num (how many were added), ts of cart rows that are new or grew."""
    new, old = F.col("data")["sku_num"].try_cast("int"), F.col("old")["sku_num"].try_cast("int")
    insert = F.col("type") == "insert"
    cart = df.where((F.col("table") == "cart_info") & (insert | ((F.col("type") == "update") & (new > old))))
    return cart.select(*(F.col("data")[c].alias(c) for c in ("id", "user_id", "sku_id")), F.when(insert, F.col("data")["sku_num"]).otherwise((new - old).cast("string")).alias("sku_num"), "ts")


def starts_session(last_page: Column) -> Column:
    """A page view that no other page led to."""
    return F.coalesce(last_page, F.lit("")) == ""


def home_and_detail(pages: DataFrame, home: str = "home", detail: str = "good_detail") -> DataFrame:
    """Views of the two pages whose visitors are counted."""
    return pages.where(F.col("page_id").isin(home, detail))


def logins(pages: DataFrame, login: str = "login") -> DataFrame:
    """Views by a known user that come from the login page, or from none (an automatic login)."""
    return pages.where((F.coalesce("uid", F.lit("")) != "") & ((F.col("last_page_id") == login) | starts_session(F.col("last_page_id"))))


def parsed_log(df: DataFrame) -> DataFrame:
    """Behaviour logs (JSON in `value`), parsed once: the text, whether it is malformed (bad), and its fields."""
    rows = df.where(F.col("value").isNotNull()).select("value", F.try_parse_json("value").isNull().alias("bad"))
    return rows.select("value", "bad", F.when(~F.col("bad"), F.from_json("value", schemas.LOG)).alias("l")).select("value", "bad", "l.*")


def with_flag(logs: DataFrame) -> DataFrame:
    """Parsed logs with the flag `is_new` put back into their common part."""
    return logs.withColumn("common", F.when(F.col("common").isNotNull(), F.col("common").withField("is_new", F.col("is_new"))))


def split_parsed(log: DataFrame) -> dict[str, DataFrame]:
    """The outputs of parsed logs: err, start, page, display, action and dirty.

    A log with an error goes to err whole and then on without it; a start log is no page log; a page log also gives a
    row for each display and each action, and leaves them out itself.
    """
    page = log.where(F.col("start").isNull() & F.col("page").isNotNull())
    return {
        "dirty": log.where("bad").select("value"),
        "err": log.where(F.col("err").isNotNull()).select("value"),
        "start": log.where(F.col("start").isNotNull()).select("common", "start", "ts"),
        "page": page.select("common", "page", "ts"),
        "display": page.select("common", "page", F.explode("displays").alias("display"), "ts"),
        "action": page.select("common", "page", F.explode("actions").alias("action"), "ts"),
    }


def split_log(df: DataFrame) -> dict[str, DataFrame]:
    """The outputs of behaviour logs (JSON in `value`), each by itself."""
    return split_parsed(parsed_log(df))


def tag_log(df: DataFrame) -> DataFrame:
    """branch, value, common, page, part, ts: the outputs of behaviour logs as tagged rows, in one pass over them.

    Each log is parsed once and gives an array of tagged parts, which is taken apart: no branch scans the logs anew.
    """
    log = parsed_log(df)
    begin, none = F.col("start").isNotNull(), F.lit(None).cast("string")
    tag = lambda name, part: F.struct(F.lit(name).alias("branch"), part.alias("part"))
    page = ~begin & F.col("page").isNotNull()
    empty = F.array().cast("array<struct<branch:string,part:string>>")
    some = lambda ok, *parts: F.when(ok, F.array(*parts)).otherwise(empty)
    many = lambda name, c: F.when(page & F.col(c).isNotNull(), F.transform(c, lambda x: tag(name, x))).otherwise(empty)
    parts = F.concat(some(F.col("bad"), tag("dirty", none)), some(F.col("err").isNotNull(), tag("err", F.col("err"))), some(begin, tag("start", F.col("start"))), some(page, tag("page", none)), many("display", "displays"), many("action", "actions"))
    return log.select("value", "common", "page", "ts", F.explode(parts).alias("t")).select("t.branch", "value", "common", "page", "t.part", "ts")


def repair_visitors(df: DataFrame, visitor: str, day: Column, flag: str, *order: Column | str) -> DataFrame:
    """df with the new-visitor flag repaired in `flag`.

    A visitor's first row fixes the day of the first visit: its own day if it says new, else the day before. A later row
    that says new on another day is corrected to '0'.
    """
    w = Window.partitionBy(visitor).orderBy(*order)
    first_day = F.first(F.when(F.col(flag) == "1", day).otherwise(F.date_sub(day, 1))).over(w)
    return df.withColumn(flag, F.when((F.col(flag) == "1") & (first_day != day), F.lit("0")).otherwise(F.col(flag)))


def to_record(df: DataFrame, *leave_out: str) -> DataFrame:
    """Rows as JSON strings in `value`; null fields are left out."""
    return df.select(F.to_json(F.struct(*(c for c in df.columns if c not in leave_out))).alias("value"))
