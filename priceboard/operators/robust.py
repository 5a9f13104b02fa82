"""Exact medians, MAD filters, exclusive quartiles, summaries and their drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import stored
from .selection import medians

Z = 3.5
DRIFT_LEAST, DRIFT_SHARE = 5.0, 0.35


def mad_scores(df: DataFrame, by: list[str], value: str, z: float = Z) -> DataFrame:
    """df's rows with a value, and kept.  Groups below four rows or without spread are kept whole.  Medians are joined back by key."""
    rows = df.filter(F.col(value).isNotNull())
    rows = stored(rows, "rows")
    mid = medians(rows, by, value).withColumnsRenamed({"m": "__m", "n": "__n"})
    dev = rows.join(mid, by).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    mad = medians(dev, by, "__d").select(*by, F.col("m").alias("__mad"))
    score = F.abs(F.lit(0.6745) * (F.col(value) - F.col("__m")) / F.col("__mad"))
    kept = F.when((F.col("__n") < 4) | (F.col("__mad") == 0), F.lit(True)).otherwise(score <= z)
    return dev.join(mad, by).withColumn("kept", kept).drop("__m", "__n", "__d", "__mad")


def summarize(df: DataFrame, by: list[str], value: str, z: float = Z) -> DataFrame:
    """Kept rows, median, least, most (one place), rejected rows and a grade."""
    s = mad_scores(df, by, value, z)
    v = F.when(F.col("kept"), F.col(value))
    s = stored(s, "scores")
    out = s.groupBy(*by).agg(F.count(v).alias("items"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(~F.col("kept")).alias("rejected"))
    out = out.join(medians(s, by, v).drop("n"), by)
    grade = F.when(F.col("items") >= 12, "high").when(F.col("items") >= 5, "medium").when(F.col("items") > 0, "low").otherwise("none")
    return out.select(*by, "items", S.rounded(F.col("m"), 1).alias("median_pct"), S.rounded(F.col("lo"), 1).alias("min_pct"), S.rounded(F.col("hi"), 1).alias("max_pct"), "rejected", grade.alias("confidence"))


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exclusive quartiles (positions k(n+1)/4) of groups of four rows or more.  Ranked, so that no group is gathered in one array."""
    w = Window.partitionBy(*by).orderBy(value)
    ranked = df.filter(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    ranked = ranked.filter("__n >= 4")
    cols = []
    for k in (1, 2, 3):
        low = F.floor(F.lit(k) * (F.col("__n") + 1) / 4)
        part = F.lit(k) * (F.col("__n") + 1) / 4 - low
        here = F.when(F.col("__r") == low, F.col(value) * (1 - part)).when(F.col("__r") == low + 1, F.col(value) * part)
        cols.append(S.rounded(F.sum(here), 4).alias(f"q{k}"))
    return ranked.groupBy(*by).agg(*cols)


def category_medians(summaries: DataFrame, category: str = "category", value: str = "median_pct") -> DataFrame:
    return medians(summaries, [category], value).select(category, S.rounded(F.col("m"), 1).alias("median_pct"))


def drift(now: DataFrame, before: DataFrame, by: list[str], value: str = "median_pct") -> DataFrame:
    """now with the change since before; flagged beyond the larger of five points and 35 % of before."""
    old = before.select(*by, F.col(value).alias("prev"))
    delta = F.col(value) - F.col("prev")
    return now.join(old, by, "left").select(
        *by, value, "prev", S.rounded(delta, 1).alias("delta"), F.coalesce(F.abs(delta) > F.greatest(F.lit(DRIFT_LEAST), F.col("prev") * DRIFT_SHARE), F.lit(False)).alias("flagged")
    )
