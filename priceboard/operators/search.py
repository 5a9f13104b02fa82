"""Search performance: trend, page groups, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def trend(rows: DataFrame) -> DataFrame:
    """rows: date, clicks, impressions, position.  Position is weighted by impressions."""
    out = rows.groupBy("date").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"))
    return out.select("date", "clicks", "impressions", S.rounded(F.coalesce(F.try_divide(F.col("clicks").cast("double"), F.col("impressions").cast("double")), F.lit(0.0)), 6).alias("ctr"), S.rounded(F.try_divide("w", "impressions"), 4).alias("position"))


def page_group(page):
    return F.when(F.contains(page, F.lit("/news/daily/")), "daily").when(F.contains(page, F.lit("/news/")), "recap").otherwise("other")


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(page_group(F.col("page")).alias("page_group")).agg(F.count_distinct("page").alias("pages"), F.sum("clicks").alias("clicks"))


def top_pages(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.groupBy("page").agg(F.sum("clicks").alias("clicks")).orderBy(F.desc("clicks"), "page").limit(n)


def top_aged(rows: DataFrame, aged: DataFrame, n: int = 30) -> DataFrame:
    """The aged pages (page) that still have clicks."""
    return top_pages(rows.join(aged.select("page").distinct(), "page", "left_semi").filter("clicks > 0"), n)
