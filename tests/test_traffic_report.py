import datetime as dt
import json
import random

from pyspark.sql import functions as F

from priceboard.operators import traffic
from priceboard.operators import traffic_report as R

VIEWS, CLICKS = "day date, page string, referrer string, host string, session_id string", "day date, page string, target string"
RANGE = ("2024-01-03", "2024-01-09")


def logs(spark, n=800, seed=1):
    rng = random.Random(seed)
    day = lambda: dt.date(2024, 1, rng.randint(1, 12))
    views = [(day(), rng.choice([*(f"/p/{i}" for i in range(60)), None]), rng.choice(["", None, *(f"r{i}" for i in range(30))]), rng.choice(["", None, "h1", "h2"]), rng.choice(["hot", "hot", "", None, *(f"s{i}" for i in range(40))])) for _ in range(n)]
    clicks = [(day(), rng.choice(["/p/1", "/p/2", None]), rng.choice([f"t{i}" for i in range(50)])) for _ in range(n)]
    return spark.createDataFrame(views, VIEWS), spark.createDataFrame(clicks, CLICKS)


def plain(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_one_scan_equals_the_separate_form(spark):
    views, clicks = logs(spark)
    for page in (None, "/p/1", "/none"):
        rows = R.report_rows(views, clicks, *RANGE, page)
        tables, apart = R.report_tables(rows.cache()), traffic.report(views, clicks, *RANGE, page)
        assert set(tables) == set(apart)
        for name, df in apart.items():
            want = df if name != "pages" else df.join(traffic.in_range(views, *RANGE, page).groupBy("page").agg(traffic._visitors().alias("visitors")).withColumnRenamed("page", "p"), F.col("page").eqNullSafe(F.col("p"))).drop("p")
            assert plain(tables[name]) == plain(want), (name, page)


def test_each_log_is_scanned_once(spark, tmp_path):
    views, clicks = logs(spark)
    views.write.parquet(f"{tmp_path}/v")
    clicks.write.parquet(f"{tmp_path}/c")
    rows = R.report_rows(spark.read.parquet(f"{tmp_path}/v"), spark.read.parquet(f"{tmp_path}/c"), *RANGE)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Expand" in plan and plan.count("FileScan parquet") == 2


def test_document(spark):
    views, clicks = logs(spark)
    doc = json.loads(R.report_json(views, clicks, *RANGE).first()[0])
    apart = traffic.report(views, clicks, *RANGE)
    assert list(doc) == ["from", "to", "page_filter", "totals", "daily", "top_pages", "top_clicks", "top_referrers", "top_hosts", "pages_list"]
    assert doc["totals"] == apart["totals"].first().asDict() and len(doc["top_pages"]) == 40 and len(doc["top_referrers"]) == 20
    assert [(r["target"], r["clicks"]) for r in doc["top_clicks"]] == [tuple(r) for r in apart["clicks"].collect()]
    assert doc["pages_list"][-1] is None and doc["pages_list"][:-1] == sorted(doc["pages_list"][:-1])
    none = json.loads(R.report_json(views.limit(0), clicks.limit(0), *RANGE, "/p/1").first()[0])
    assert none == {"from": RANGE[0], "to": RANGE[1], "page_filter": "/p/1", "totals": {"views": 0, "visitors": 0, "clicks": 0}, **{k: [] for k in ("daily", "top_pages", "top_clicks", "top_referrers", "top_hosts", "pages_list")}}


def test_table_function(spark):
    views, clicks = logs(spark)
    views.createOrReplaceTempView("page_views")
    clicks.createOrReplaceTempView("click_events")
    R.register_report(spark)
    for page in (None, "/p/2"):
        arg = "NULL" if page is None else f"'{page}'"
        got = spark.sql(f"SELECT * FROM analytics_report(DATE '{RANGE[0]}', DATE '{RANGE[1]}', {arg})")
        assert plain(got) == plain(R.report_rows(views, clicks, *RANGE, page))
    assert spark.sql("SELECT * FROM analytics_report() WHERE part = 'daily'").collect() == []
    named = spark.sql("SELECT count(*) FROM analytics_report(p_to => DATE '2024-01-05', p_from => DATE '2024-01-05') WHERE part = 'daily'").first()[0]
    assert named == 1
