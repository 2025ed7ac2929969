"""Dimension lookups as joins. A dimension is broadcast only while it is small; beyond that Spark shuffles both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, by the optimizer's statistics, up to which a dimension is broadcast.
SMALL = 64 << 20


def small(dim: DataFrame) -> DataFrame:
    """dim with a broadcast hint if its size is known to be under SMALL."""
    size = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(dim) if size <= SMALL else dim


def enrich(df: DataFrame, dim: DataFrame, key: str, dim_key: str, how: str = "left", **columns: str) -> DataFrame:
    """df with columns new=old of the dimension row of its key; without one they are null (or the row goes: inner)."""
    d = small(dim.select(F.col(dim_key).alias("_key"), *(F.col(old).alias(new) for new, old in columns.items())))
    return df.join(d, F.col(key) == F.col("_key"), how).drop("_key")


def decode(df: DataFrame, dic: DataFrame, code: str, name: str) -> DataFrame:
    """Inner lookup in a dictionary (dic_code, dic_name)."""
    return enrich(df, dic, code, "dic_code", "inner", **{name: "dic_name"})


def sku_snowflake(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Names and ids from sku to spu, trademark and three categories; a missing sku leaves nulls all the way."""
    out = enrich(df, dims["dim_sku_info"], "sku_id", "id", sku_name="sku_name", spu_id="spu_id", category3_id="category3_id", trademark_id="tm_id")
    out = enrich(out, dims["dim_spu_info"], "spu_id", "id", spu_name="spu_name")
    out = enrich(out, dims["dim_base_trademark"], "trademark_id", "id", trademark_name="tm_name")
    out = enrich(out, dims["dim_base_category3"], "category3_id", "id", category3_name="name", category2_id="category2_id")
    out = enrich(out, dims["dim_base_category2"], "category2_id", "id", category2_name="name", category1_id="category1_id")
    return enrich(out, dims["dim_base_category1"], "category1_id", "id", category1_name="name")


def province(df: DataFrame, dim: DataFrame) -> DataFrame:
    return enrich(df, dim, "province_id", "id", province_name="name")
