"""Page views and clicks: rollups and the tables of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: What the location button says, and what it is called.
LOCATION_PHRASES, LOCATION_LABEL = ["Use my current location", "location to autofill"], "Use my location (autofill)"
MAX_PAGES = 100_000
TOP = {"pages": 40, "clicks": 40, "referrers": 20, "hosts": 10}


def in_range(df: DataFrame, start: str, end: str, page: str | None = None) -> DataFrame:
    out = df.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out if page is None else out.filter(F.col("page") == page)


def _visitors():
    return F.count_distinct(F.nullif(F.col("session_id").cast("string"), F.lit("")))


def daily_hits(views: DataFrame) -> DataFrame:
    return views.groupBy("day").agg(F.count("*").alias("views"), _visitors().alias("visitors"))


def daily_top(df: DataFrame, key: str, n: str) -> DataFrame:
    return df.groupBy("day", key).agg(F.count("*").alias(n))


def totals(views: DataFrame, clicks: DataFrame) -> DataFrame:
    """One row; both logs have had the same filters."""
    v = views.agg(F.count("*").alias("views"), _visitors().alias("visitors"))
    return v.crossJoin(F.broadcast(clicks.agg(F.count("*").alias("clicks"))))  # one row each


def top(df: DataFrame, key: str, n: int, count: str, label: str | None = None) -> DataFrame:
    """The n most frequent keys; ties by key."""
    k = S.label_blank(F.col(key), label) if label else F.col(key)
    return df.groupBy(k.alias(key)).agg(F.count("*").alias(count)).orderBy(F.desc(count), key).limit(n)


def page_list(views: DataFrame) -> DataFrame:
    return views.select("page").distinct().orderBy("page")


def report(views: DataFrame, clicks: DataFrame, start: str, end: str, page: str | None = None) -> dict[str, DataFrame]:
    """The dashboard's tables.  The page list keeps all pages of the range: it feeds the page selector."""
    v, c = in_range(views, start, end, page), in_range(clicks, start, end, page)
    return {
        "totals": totals(v, c), "daily": daily_hits(v).orderBy("day"), "pages": top(v, "page", TOP["pages"], "views"), "clicks": top(c, "target", TOP["clicks"], "clicks"),
        "referrers": top(v, "referrer", TOP["referrers"], "views", "(direct)"), "hosts": top(v, "host", TOP["hosts"], "views", "(unknown)"), "page_list": page_list(in_range(views, start, end)),
    }


def total_visits(views: DataFrame) -> DataFrame:
    return views.agg(_visitors().alias("visits"))


def friendly_label(df: DataFrame, names: DataFrame, target: str = "target") -> DataFrame:
    """names: target, label.  Blank is '(unlabelled)'; of other targets a name goes first, then the phrases of the location button and the
    columns of karats; the rest loses leading marks that are not ASCII, unless nothing else is left of it."""
    t = F.col(target)
    place = F.exists(F.array(*map(F.lit, LOCATION_PHRASES)), lambda x: F.contains(t, x))
    plain = F.coalesce(F.nullif(F.trim(F.regexp_replace(t, r"^[^\x00-\x7F]+\s*", "")), F.lit("")), t)
    known = F.when(place, LOCATION_LABEL).when(t.isin(list(S.FRACTION)), F.concat(t, F.lit(" rate column"))).otherwise(plain)
    return df.join(names, target, "left").withColumn("label", F.when(F.coalesce(t, F.lit("")) == "", "(unlabelled)").otherwise(F.coalesce("label", known)))
