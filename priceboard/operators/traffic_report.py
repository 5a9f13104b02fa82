"""The traffic report in one scan of each log: all its tables by GROUPING SETS, as rows, as tables, as one document, and as a SQL table function.

Views are grouped at once by (day, session), (page, session), session, referrer and host, then without the session: what is left of a
session is a visitor.  A session that holds a third of all views is one row for each task after the partial sums.  The best of each
list are found in PARTS shares first (each keeps no more than the longest list), then among what these keep, so no task sorts all keys of a
list.  Pages of the whole range feed the page selector, so the page filter is a column of the sums and not a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import stored
from .traffic import MAX_PAGES, in_range

#: The lists of the report and how long they are.
TOP = {"top_pages": 40, "top_clicks": 40, "top_referrers": 20, "top_hosts": 10}
LONGEST = max(TOP.values())
PARTS = 64


def _sums(views: DataFrame, clicks: DataFrame, page: str | None) -> DataFrame:
    """part, key, views, visitors, clicks: all groups of all parts."""
    own = F.lit(True) if page is None else F.col("page").eqNullSafe(F.lit(page))
    v = views.select(
        F.col("day").cast("string").alias("day"), "page", S.label_blank(F.col("referrer"), "(direct)").alias("referrer"), S.label_blank(F.col("host"), "(unknown)").alias("host"),
        F.nullif(F.col("session_id").cast("string"), F.lit("")).alias("session"), own.alias("own"),
    )
    by = v.groupingSets([["day", "session"], ["page", "session"], ["referrer"], ["host"], ["session"]], "day", "page", "referrer", "host", "session")
    each = by.agg(F.count_if("own").alias("views"), F.grouping_id().alias("gid"))
    # bits of gid, from the left: day, page, referrer, host, session; one where the column is not in the set
    part = F.when(F.col("gid") == 0b01110, "daily").when(F.col("gid") == 0b10110, "pages").when(F.col("gid") == 0b11011, "top_referrers").when(F.col("gid") == 0b11101, "top_hosts").otherwise("totals")
    key = F.coalesce("day", "page", "referrer", "host")
    seen = F.count_if(F.col("session").isNotNull() & (F.col("views") > 0))
    s = each.select(part.alias("part"), key.alias("key"), "session", "views").groupBy("part", "key").agg(F.sum("views").alias("views"), seen.alias("visitors"))
    # a page is in the selector by any view, and in the list by those that the page filter takes
    parts = F.when(F.col("part") == "pages", F.array(F.lit("top_pages"), F.lit("pages_list"))).otherwise(F.array("part"))
    s = s.withColumn("part", F.explode(parts)).filter("views > 0 OR part = 'pages_list'")
    c = clicks if page is None else clicks.filter(F.col("page") == page)
    c = c.groupingSets([["target"], []], "target").agg(F.count("*").alias("clicks"), F.grouping_id().alias("gid"))
    c = c.select(F.when(F.col("gid") == 0, "top_clicks").otherwise("click_totals").alias("part"), F.col("target").alias("key"), "clicks")
    none = F.lit(None).cast("long")
    visitors = F.when(F.col("part").isin("totals", "daily", "top_pages"), F.col("visitors")).alias("visitors")
    return s.select("part", "key", "views", visitors, none.alias("clicks")).unionByName(c.select("part", "key", none.alias("views"), none.alias("visitors"), "clicks"))


def _amount() -> Column:
    return F.coalesce("clicks", "views")


def report_rows(views: DataFrame, clicks: DataFrame, start: str, end: str, page: str | None = None) -> DataFrame:
    """part, key, rank (of the lists; ties by key, null last), views, visitors, clicks."""
    s = _sums(in_range(views, start, end), in_range(clicks, start, end), page)
    listed = F.col("part").isin(list(TOP))
    order = [F.desc(_amount()), F.asc_nulls_last("key")]
    s = s.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("part", "share").orderBy(*order))).filter(~listed | (F.col("rank") <= LONGEST))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("part", F.when(~listed, F.col("share"))).orderBy(*order)))
    most = F.create_map(*(x for k, n in TOP.items() for x in (F.lit(k), F.lit(n))))
    s = s.filter(~listed | (F.col("rank") <= F.try_element_at(most, F.col("part"))))
    return s.select("part", "key", F.when(listed, F.col("rank")).alias("rank"), "views", "visitors", "clicks")


def report_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of stored rows."""
    of = lambda part: rows.filter(F.col("part") == part)
    t = rows.agg(*(F.coalesce(F.max(F.when(F.col("part") == p, F.col(c))), F.lit(0)).alias(c) for p, c in (("totals", "views"), ("totals", "visitors"), ("click_totals", "clicks"))))
    return {
        "totals": t, "daily": of("daily").select(F.col("key").cast("date").alias("day"), "views", "visitors"), "pages": of("top_pages").select(F.col("key").alias("page"), "views", "visitors"),
        "clicks": of("top_clicks").select(F.col("key").alias("target"), "clicks"), "referrers": of("top_referrers").select(F.col("key").alias("referrer"), "views"),
        "hosts": of("top_hosts").select(F.col("key").alias("host"), "views"), "page_list": of("pages_list").select(F.col("key").alias("page")),
    }


def report_document(rows: DataFrame, start: str, end: str, page: str | None = None) -> DataFrame:
    """One row of JSON of stored rows; an empty table is an empty array.  A range of more than MAX_PAGES pages is refused, since one row cannot hold
    its list; the rows and tables have no such limit."""
    if rows.filter("part = 'pages_list'").limit(MAX_PAGES + 1).count() > MAX_PAGES:
        raise ValueError(f"more than {MAX_PAGES} pages in the range")

    def listed(part: str, name: str, *counts: str) -> Column:
        row = F.struct(F.coalesce("rank", F.lit(0)).alias("rank"), F.col("key").isNull().alias("last"), "key", *counts)
        got = F.array_sort(F.collect_list(F.when(F.col("part") == part, row)))
        return F.transform(got, lambda r: F.struct(r["key"].alias(name), *(r[c].alias(c) for c in counts))).alias(part)

    total = lambda part, c: F.coalesce(F.max(F.when(F.col("part") == part, F.col(c))), F.lit(0)).alias(c)
    pages = F.array_sort(F.collect_list(F.when(F.col("part") == "pages_list", F.struct(F.col("key").isNull().alias("last"), "key"))))
    body = rows.agg(
        F.struct(total("totals", "views"), total("totals", "visitors"), total("click_totals", "clicks")).alias("totals"), listed("daily", "day", "views", "visitors"), listed("top_pages", "page", "views", "visitors"),
        listed("top_clicks", "target", "clicks"), listed("top_referrers", "referrer", "views"), listed("top_hosts", "host", "views"), F.transform(pages, lambda r: r["key"]).alias("pages_list"),
    )
    head = [F.lit(start).alias("from"), F.lit(end).alias("to"), F.lit(page).cast("string").alias("page_filter")]
    return body.select(F.to_json(F.struct(*head, *body.columns), {"ignoreNullFields": "false"}).alias("report"))


def report_json(views: DataFrame, clicks: DataFrame, start: str, end: str, page: str | None = None) -> DataFrame:
    return report_document(stored(report_rows(views, clicks, start, end, page), "report"), start, end, page)


def register_report(spark: SparkSession, views: str = "page_views", clicks: str = "click_events", name: str = "analytics_report") -> None:
    """The SQL table function name(from, to, page) over two tables or views of the session: the rows of the report.  Without dates, the fourteen days to today's local one."""
    lists = ", ".join(f"'{k}'" for k in TOP)
    most = " ".join(f"WHEN '{k}' THEN {n}" for k, n in TOP.items())
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(p_from DATE DEFAULT NULL, p_to DATE DEFAULT NULL, p_page STRING DEFAULT NULL)
RETURNS TABLE (part STRING, key STRING, rank INT, views BIGINT, visitors BIGINT, clicks BIGINT)
RETURN
WITH d AS (SELECT coalesce(p_to, to_date(from_utc_timestamp(current_timestamp(), 'Asia/Kolkata'))) AS upto),
r AS (SELECT coalesce(p_from, date_sub(to_date(from_utc_timestamp(current_timestamp(), 'Asia/Kolkata')), 13)) AS since, upto FROM d),
v AS (
  SELECT CAST(day AS STRING) AS day, page, coalesce(nullif(referrer, ''), '(direct)') AS referrer, coalesce(nullif(host, ''), '(unknown)') AS host, nullif(CAST(session_id AS STRING), '') AS session,
         p_page IS NULL OR page <=> p_page AS own
  FROM {views} JOIN r ON day BETWEEN since AND upto
), e AS (
  SELECT day, page, referrer, host, session, count_if(own) AS views, grouping_id(day, page, referrer, host, session) AS gid
  FROM v GROUP BY day, page, referrer, host, session GROUPING SETS ((day, session), (page, session), (referrer), (host), (session))
), s AS (
  SELECT CASE gid WHEN 14 THEN 'daily' WHEN 22 THEN 'pages' WHEN 27 THEN 'top_referrers' WHEN 29 THEN 'top_hosts' ELSE 'totals' END AS part, coalesce(day, page, referrer, host) AS key,
         sum(views) AS views, count_if(session IS NOT NULL AND views > 0) AS visitors
  FROM e GROUP BY 1, 2
), c AS (
  SELECT target AS key, count(*) AS clicks, grouping_id(target) AS gid FROM {clicks} JOIN r ON day BETWEEN since AND upto
  WHERE p_page IS NULL OR page = p_page GROUP BY GROUPING SETS ((target), ())
), a AS (
  SELECT part, key, views, IF(part IN ('totals', 'daily', 'top_pages'), visitors, NULL) AS visitors, clicks FROM (SELECT explode(if(part = 'pages', array('top_pages', 'pages_list'), array(part))) AS part, key, views, visitors, CAST(NULL AS BIGINT) AS clicks FROM s) WHERE views > 0 OR part = 'pages_list'
  UNION ALL SELECT if(gid = 0, 'top_clicks', 'click_totals'), key, NULL, NULL, clicks FROM c
), l AS (
  SELECT *, row_number() OVER (PARTITION BY part, share ORDER BY coalesce(clicks, views) DESC, key NULLS LAST) AS place FROM (SELECT *, pmod(xxhash64(key), {PARTS}) AS share FROM a)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY part, IF(part IN ({lists}), NULL, share) ORDER BY coalesce(clicks, views) DESC, key NULLS LAST) AS rank FROM l WHERE part NOT IN ({lists}) OR place <= {LONGEST}
)
SELECT part, key, IF(part IN ({lists}), rank, NULL) AS rank, views, visitors, clicks FROM t WHERE part NOT IN ({lists}) OR rank <= CASE part {most} END
""")


#: The rows for DuckDB, over tables views and clicks of the range: {{own}} says which the page filter takes.
ROWS_SQL = """
v AS (SELECT CAST(day AS VARCHAR) AS day, page, coalesce(nullif(referrer, ''), '(direct)') AS referrer, coalesce(nullif(host, ''), '(unknown)') AS host, session_id, {own} AS own FROM views WHERE {within}),
g AS (
  SELECT CASE WHEN grouping(day) = 0 THEN 'daily' WHEN grouping(page) = 0 THEN 'top_pages' WHEN grouping(referrer) = 0 THEN 'top_referrers' WHEN grouping(host) = 0 THEN 'top_hosts' ELSE 'totals' END AS part,
         coalesce(day, page, referrer, host) AS key, count(*) AS views, count(DISTINCT session_id) AS visitors, CAST(NULL AS BIGINT) AS clicks
  FROM v WHERE own GROUP BY GROUPING SETS ((day), (page), (referrer), (host), ())
  UNION ALL SELECT CASE WHEN grouping(target) = 0 THEN 'top_clicks' ELSE 'click_totals' END, target, NULL, NULL, count(*) FROM clicks WHERE {within} AND {own} GROUP BY GROUPING SETS ((target), ())
), t AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY coalesce(clicks, views) DESC, key NULLS LAST)::INT AS rank FROM g),
report AS (
  SELECT part, key, CASE WHEN part LIKE 'top%' THEN rank END AS rank, views, CASE WHEN part IN ('top_referrers', 'top_hosts') THEN NULL ELSE visitors END AS visitors, clicks
  FROM t WHERE part NOT LIKE 'top%' OR rank <= CASE part WHEN 'top_referrers' THEN 20 WHEN 'top_hosts' THEN 10 ELSE 40 END
  UNION ALL SELECT 'pages_list', page, NULL, count_if(own), NULL, NULL FROM v GROUP BY page
)"""
DOCUMENT_SQL = """
SELECT to_json({{'from': '{start}', 'to': '{end}', 'page_filter': {page},
  'totals': (SELECT {{'views': coalesce(max(views) FILTER (part = 'totals'), 0), 'visitors': coalesce(max(visitors) FILTER (part = 'totals'), 0), 'clicks': coalesce(max(clicks) FILTER (part = 'click_totals'), 0)}} FROM report),
  'daily': (SELECT coalesce(list({{'day': key, 'views': views, 'visitors': visitors}} ORDER BY key), []) FROM report WHERE part = 'daily'),
  'top_pages': (SELECT coalesce(list({{'page': key, 'views': views, 'visitors': visitors}} ORDER BY rank), []) FROM report WHERE part = 'top_pages'),
  'top_clicks': (SELECT coalesce(list({{'target': key, 'clicks': clicks}} ORDER BY rank), []) FROM report WHERE part = 'top_clicks'),
  'top_referrers': (SELECT coalesce(list({{'referrer': key, 'views': views}} ORDER BY rank), []) FROM report WHERE part = 'top_referrers'),
  'top_hosts': (SELECT coalesce(list({{'host': key, 'views': views}} ORDER BY rank), []) FROM report WHERE part = 'top_hosts'),
  'pages_list': (SELECT coalesce(list(key ORDER BY key), []) FROM report WHERE part = 'pages_list')}})::VARCHAR AS report"""
