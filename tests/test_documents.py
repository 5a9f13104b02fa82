"""Seeds and patches by key, XML documents, feeds, and the dashboard."""

import datetime as dt

from pyspark.sql import functions as F

from priceboard.operators import pages
from priceboard.plans import runs
from priceboard.sources import readers, sinks

DAY = dt.date(2024, 3, 5)


def test_several_seeds_of_a_slug(spark):
    old = spark.createDataFrame([("a", "A", None), ("b", "B", "/b")], "slug string, name string, rate_url string")
    seed = spark.createDataFrame([("a", "/1", 1), ("a", "/2", 2), ("c", "/3", 1), ("c", None, 2)], "slug string, rate_url string, seq int")
    got = sinks.merge_brands(old, seed, ["rate_url"], order="seq")
    assert sorted(map(tuple, got.collect())) == [("a", "A", "/2"), ("b", "B", "/b"), ("c", None, None)]
    rates = spark.createDataFrame([(1, DAY, 5.0, "published"), (2, DAY, 6.0, "published")], "brand_id long, rate_date date, canonical double, status string")
    patch = spark.createDataFrame([(1, DAY, "held", 1), (1, DAY, "quarantined", 2)], "brand_id long, rate_date date, status string, seq int")
    assert sorted(r["status"] for r in sinks.patch_rates(rates, patch, order="seq").collect()) == ["published", "quarantined"]


def locations(spark, body):
    return spark.createDataFrame([(body,)], "b string").select(readers.locs(F.col("b")).alias("l")).first()["l"]


def test_locations(spark):
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    assert locations(spark, head + '<urlset xmlns="x"><url><loc> https://a.in/p?a=1&amp;b=2 </loc></url><url><loc><![CDATA[https://a.in/q?a=1&b=2]]></loc><lastmod>2024</lastmod></url></urlset>') == ["https://a.in/p?a=1&b=2", "https://a.in/q?a=1&b=2"]
    assert locations(spark, '<m:sitemapindex xmlns:m="x"><m:sitemap a="1"><m:loc l="en">https://a.in/s.xml</m:loc></m:sitemap></m:sitemapindex>') == ["https://a.in/s.xml"]
    assert locations(spark, "<url><loc>https://a.in/broken</loc><url>") == ["https://a.in/broken"]
    assert locations(spark, "") == [] and locations(spark, "<html></html>") == []


def test_sitemap_documents(spark, tmp_path):
    rows = spark.createDataFrame([(f"https://a.in/{i}?x=<&>\"'", DAY, "daily", 0.5) for i in range(7)], "loc string, lastmod date, changefreq string, priority double")
    sinks.write_sitemap(rows.coalesce(1), f"{tmp_path}/s")
    (file,) = (tmp_path / "s").glob("part-*")
    text = file.read_text()
    assert text.count("<url>") == 7 and f'<urlset xmlns="{sinks.SITEMAP_NAMESPACE}">' in text and text.rstrip().endswith("</urlset>")
    assert sorted(map(tuple, readers.read_sitemap_files(spark, f"{tmp_path}/s").collect())) == sorted(map(tuple, rows.collect()))


def test_order_of_feeds(spark):
    item = lambda t, link: f"<item><title>{t}</title><link>{link}</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>"
    rss = lambda *items: "<rss><channel>" + "".join(items) + "</channel></rss>"
    feeds = spark.createDataFrame([(1, rss(item("Second feed has news", "s"), item("Gold is the same today", "late"))), (0, rss(item("Gold is the same today", "early"), item("Gold &amp; silver prices", "ab"))), (2, "")], "feed int, body string")
    got = pages.dedupe_news(readers.read_news_rss(feeds)).collect()
    assert [(r["feed"], r["place"], r["title"], r["link"]) for r in got] == [(0, 0, "Gold is the same today", "early"), (0, 1, "Gold & silver prices", "ab"), (1, 0, "Second feed has news", "s")]


def test_dashboard_prices_only_brands_with_both(spark):
    live = spark.createDataFrame([("a", 9000.0), ("b", 8900.0), ("unpriced", 1.0)], "name string, canonical double")
    charges = spark.createDataFrame([("a", "Ring", 5.0, 12, "high"), ("b", "Ring", 20.0, 3, "low"), ("gone", "Ring", 1.0, 9, "medium")], "brand string, category string, median_pct double, items long, confidence string")
    scenarios = spark.createDataFrame([(1, "Ring", "22K", 10.0)], "scenario int, category string, karat string, weight double")
    d = runs.making_dashboard(live, charges, scenarios, 100_000.0)
    assert {(r["name"], r["karat"], r["rate"]) for r in d["prices"].collect()} == {("a", "24K", 9000.0), ("a", "22K", 8250.0), ("a", "18K", 6750.0), ("b", "24K", 8900.0), ("b", "22K", 8158.33), ("b", "18K", 6675.0)}
    trap = d["traps"].first()
    assert (trap["least_rate_brand"], trap["least_total_brand"]) == ("b", "a") and trap["extra_cost"] > 0
    assert {r["name"] for r in d["grams"].collect()} == {"a", "b"}


def test_page_archive(spark, tmp_path):
    rows = spark.createDataFrame([("gold-rate-pune-05-mar-2024.html", "<p>é</p>"), ("gold-rate-navi-mumbai-06-mar-2024.html", "<p>2</p>")], "name string, html string")
    readers.write_page_archive(rows, f"{tmp_path}/a")
    got = {r["place"]: r for r in readers.read_page_archive(spark, f"{tmp_path}/a").collect()}
    assert got["Pune"]["day"] == DAY and got["Pune"]["html"].strip() == "<p>é</p>" and got["Navi Mumbai"]["bytes"] == 9 and got["Pune"]["saved"] is not None
