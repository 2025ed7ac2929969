"""Word segmentation for search terms.

`words` stays in SQL: runs of letters and digits. `ik_analyze` is a table function that also cuts runs of Chinese
characters, by the longest match in a small dictionary, a single character where nothing matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common shop terms, an example of a dictionary (fixed values).
DICTIONARY = frozenset("手机 电脑 笔记本 电视 冰箱 洗衣机 耳机 口红 唇釉 香水 衣服 鞋子 图书 红色 黑色 白色 小米 华为 苹果 联想 游戏本 轻薄 官方 旗舰店".split())
_RUN = re.compile(r"[0-9a-z]+|[一-鿿]+")


def segment(text: str | None, dictionary: frozenset[str] = DICTIONARY) -> list[str]:
    out: list[str] = []
    longest = max(map(len, dictionary), default=1)
    for m in _RUN.finditer((text or "").lower()):
        run, i = m.group(), 0
        if run[0] < "一":
            out.append(run)
            continue
        while i < len(run):
            n = next((n for n in range(min(longest, len(run) - i), 1, -1) if run[i : i + n] in dictionary), 1)
            out.append(run[i : i + n])
            i += n
    return out


class IkAnalyze:
    """ik_analyze(text) -> rows of keyword."""

    def eval(self, text: str):
        for w in segment(text):
            yield (w,)


def register(spark: SparkSession) -> None:
    spark.udtf.register("ik_analyze", F.udtf(IkAnalyze, returnType="keyword string"))


def words(c: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9 as an array, without Python."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def search_terms(pages: DataFrame) -> DataFrame:
    """full_word, et of page views that a search led to; `page` is a map."""
    p = F.col("page")
    return pages.where(p["last_page_id"].isin("search", "home") & (p["item_type"] == "keyword") & p["item"].isNotNull()).select(p["item"].alias("full_word"), "et")


def keywords(terms: DataFrame) -> DataFrame:
    """terms with a row for each keyword: a lateral join with the table function."""
    register(terms.sparkSession)
    return terms.sparkSession.sql("SELECT t.*, k.keyword FROM {terms} t, LATERAL ik_analyze(t.full_word) k", terms=terms)
