"""Registered queries of the traffic report: its rows, its document, and the SQL table function."""

from __future__ import annotations

import uuid

from ..operators import traffic_report as R
from . import bindings as B
from .queries import IN, RANGE, VC, query

ALL = R.ROWS_SQL.format(own="true", within=IN)
ONE = R.ROWS_SQL.format(own="page = '/p/3'", within=IN)
OUT = "SELECT part, key, rank, views, visitors, clicks FROM report"


@query(f"{VC}, {ONE} {OUT}")
def traffic_report_rows(spark, sf):
    return R.report_rows(B.views(spark, sf), B.clicks(spark, sf), *RANGE, "/p/3")


@query(f"{VC}, {ALL} {R.DOCUMENT_SQL.format(start=RANGE[0], end=RANGE[1], page='CAST(NULL AS VARCHAR)')}")
def traffic_report_json(spark, sf):
    return R.report_json(B.views(spark, sf), B.clicks(spark, sf), *RANGE)


@query(f"{VC}, {ONE} {R.DOCUMENT_SQL.format(start=RANGE[0], end=RANGE[1], page=repr('/p/3'))}")
def traffic_report_page_json(spark, sf):
    return R.report_json(B.views(spark, sf), B.clicks(spark, sf), *RANGE, "/p/3")


@query(f"{VC}, {ALL} {OUT}")
def analytics_report(spark, sf):
    """Through SQL: names of the session's own for the two logs and the function, so that queries do not meet."""
    n = uuid.uuid4().hex
    B.views(spark, sf).createOrReplaceTempView(f"page_views_{n}")
    B.clicks(spark, sf).createOrReplaceTempView(f"click_events_{n}")
    R.register_report(spark, f"page_views_{n}", f"click_events_{n}", f"analytics_report_{n}")
    return spark.sql(f"SELECT * FROM analytics_report_{n}(DATE '{RANGE[0]}', DATE '{RANGE[1]}', NULL)")
