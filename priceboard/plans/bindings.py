"""The library's tables made from the test tables: as DataFrames, and as SQL with the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import board

AS_OF = "2001-06-30"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """brand_id, rate_date, purity, value, includes_gst, seq."""
    k = F.pmod("l_linenumber", F.lit(4))
    purity = F.when(k == 0, "24K").when(k == 1, "22K").when(k == 2, "18K").otherwise("14K")
    li = table(spark, sf, "lineitem").withColumn("purity", purity)
    return li.select(
        F.col("l_suppkey").alias("brand_id"), F.to_date("l_shipdate").alias("rate_date"), "purity",
        (F.col("l_extendedprice") / F.col("l_quantity") * S.purity_fraction(F.col("purity"))).alias("value"),
        (F.col("l_returnflag") == "R").alias("includes_gst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_tax",
    )


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """brand_id, rate_date, source_purity, source_value, purities_found, canonical, status."""
    r = board.rates_from_quotes(quotes(spark, sf), ["brand_id", "rate_date"])
    return r.withColumn("status", F.when(F.pmod(F.col("brand_id") + F.dayofyear("rate_date"), F.lit(10)) == 0, "quarantined").otherwise("published"))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """brand_id, name, state, national, states.  Brands of region 4 are regional."""
    n = table(spark, sf, "nation")
    b = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return b.select(F.col("s_suppkey").alias("brand_id"), F.col("s_name").alias("name"), F.col("n_name").alias("state"), (F.col("n_regionkey") != 4).alias("national"), F.array("n_name").alias("states"))


def live_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The newest published day's rows with their brands."""
    return board.with_brands(board.latest_published(rates(spark, sf), F.lit(AS_OF).cast("date"), None), brands(spark, sf))


def views(spark: SparkSession, sf: str) -> DataFrame:
    """id, ts, day, page, referrer, host, session_id."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").filter(F.col("event_type").isin("view", "signup")).withColumn("k", k)
    return e.select(
        F.col("event_id").alias("id"), "ts", S.local_day(F.col("ts")).alias("day"), F.concat(F.lit("/p/"), (F.col("k") % 10).cast("string")).alias("page"),
        F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, F.concat(F.lit("https://ref"), (F.col("k") % 7).cast("string"))).alias("referrer"),
        F.when(F.col("k") % 4 > 0, F.concat(F.lit("host"), (F.col("k") % 4).cast("string"))).alias("host"), F.col("user_id").alias("session_id"),
    )


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """id, ts, day, page, target, session_id, label, ms."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").filter("event_type = 'click'").withColumn("k", k)
    return e.select(
        F.col("event_id").alias("id"), "ts", S.local_day(F.col("ts")).alias("day"), F.concat(F.lit("/p/"), (F.col("k") % 10).cast("string")).alias("page"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("target"),
        F.col("user_id").alias("session_id"), F.concat(F.lit("l"), (F.col("k") % 3).cast("string")).alias("label"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


def subscribers(spark: SparkSession, sf: str) -> DataFrame:
    """id, key, name, email, city, offers_optin, signup_method, unsub_token, last_emailed, updated_at."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), F.concat(F.lit("u"), k.cast("string"), F.lit("@example.org")).alias("key"), F.col("c_name").alias("name"), F.concat(F.lit("U"), k.cast("string"), F.lit("@example.org")).alias("email"),
        F.when(k % 3 > 0, F.col("c_mktsegment")).alias("city"), (k % 2 == 0).alias("offers_optin"), F.when(k % 5 == 0, "google").otherwise("manual").alias("signup_method"),
        F.when(k % 7 > 0, F.concat(F.lit("tok"), k.cast("string"))).alias("unsub_token"), F.when(k % 4 > 0, F.date_sub(F.lit("2024-02-01").cast("date"), (k % 3).cast("int"))).alias("last_emailed"), F.lit("2024-01-01").cast("date").alias("updated_at"),
    )


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """seq, email, name, city, offers_optin, signup_method: what customers with orders send, and some strangers."""
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    who = F.when(k % 11 == 0, "").when(k % 13 == 0, F.concat(F.lit("new"), c.cast("string"), F.lit("@example.org"))).otherwise(F.concat(F.lit(" u"), c.cast("string"), F.lit("@Example.org ")))
    return o.select(
        k.alias("seq"), who.alias("email"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("N"), (k % 100).cast("string"))).alias("name"), F.when(k % 4 == 0, F.concat(F.lit("C"), (k % 10).cast("string"))).alias("city"),
        F.when(k % 5 == 0, k % 2 == 0).alias("offers_optin"), F.when(k % 6 == 0, "google").when(k % 6 == 1, "manual").alias("signup_method"),
    )


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """name, category, url, pct, confidence, items: making charges of products."""
    p = table(spark, sf, "part")
    pct = F.col("p_retailprice") / 100 + F.col("p_size") / 10
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.concat(F.lit("/products/"), F.col("p_partkey").cast("string")).alias("url"), pct.alias("pct"), (F.col("p_size") / 50).alias("confidence"), (F.pmod("p_partkey", F.lit(17)) == 0).alias("hit"))


D = lambda x, p=2: f"CAST(round(CAST({x} AS DECIMAL(24,6)), {p}) AS DOUBLE)"
FRAC = lambda c: f"(CASE {c} WHEN '24K' THEN CAST(1.0 AS DOUBLE) WHEN '22K' THEN CAST(22 AS DOUBLE)/24 WHEN '18K' THEN CAST(0.75 AS DOUBLE) WHEN '14K' THEN CAST(14 AS DOUBLE)/24 END)"

QUOTES = f"""q0 AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN '24K' WHEN 1 THEN '22K' WHEN 2 THEN '18K' ELSE '14K' END AS purity FROM lineitem),
quotes AS (SELECT l_suppkey AS brand_id, CAST(l_shipdate AS DATE) AS rate_date, purity, l_extendedprice / l_quantity * {FRAC('purity')} AS value,
  l_returnflag = 'R' AS includes_gst, l_orderkey * 10 + l_linenumber AS seq, l_tax FROM q0)"""
CANON = D(f"value / {FRAC('purity')} / (CASE WHEN includes_gst THEN CAST(1.03 AS DOUBLE) ELSE 1 END)")
RATES = f"""{QUOTES},
r0 AS (SELECT *, row_number() OVER (PARTITION BY brand_id, rate_date ORDER BY {FRAC('purity')} DESC, seq DESC) AS rn FROM quotes),
rp AS (SELECT brand_id, rate_date, count(DISTINCT purity)::INT AS purities_found FROM quotes GROUP BY ALL),
rates AS (SELECT brand_id, rate_date, purity AS source_purity, value AS source_value, purities_found, {CANON} AS canonical,
  CASE WHEN (brand_id + dayofyear(rate_date)) % 10 = 0 THEN 'quarantined' ELSE 'published' END AS status FROM r0 JOIN rp USING (brand_id, rate_date) WHERE rn = 1)"""
BRANDS = "brands AS (SELECT s_suppkey AS brand_id, s_name AS name, n_name AS state, n_regionkey <> 4 AS national, [n_name] AS states FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
PUBLISHED = "pub AS (SELECT * FROM rates WHERE status = 'published' AND canonical > 0)"
LIVE = f"""{RATES}, {BRANDS}, {PUBLISHED},
live AS (SELECT pub.*, name, state, national, states FROM pub JOIN brands USING (brand_id) WHERE rate_date = (SELECT max(rate_date) FROM pub WHERE rate_date <= DATE '{AS_OF}'))"""
STATS = """base AS (SELECT * FROM live WHERE national OR NOT EXISTS (SELECT 1 FROM live WHERE national)),
stats AS (SELECT median(canonical) AS m, min(canonical) AS lowest, max(canonical) AS highest, count(*) AS n,
  (SELECT name FROM base ORDER BY canonical, name LIMIT 1) AS lowest_brand, (SELECT name FROM base ORDER BY canonical DESC, name DESC LIMIT 1) AS highest_brand FROM base)"""
TREND = f"{RATES}, {PUBLISHED}, trend AS (SELECT rate_date, median(canonical) AS median_24k FROM pub WHERE rate_date BETWEEN DATE '{AS_OF}' - 120 AND DATE '{AS_OF}' GROUP BY 1)"
DAY = "CAST(ts + INTERVAL 330 MINUTE AS DATE)"
EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
VIEWS = f"""{EV}, views AS (SELECT event_id AS id, ts, {DAY} AS day, '/p/' || (k % 10) AS page, CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'https://ref' || (k % 7) END AS referrer,
  CASE WHEN k % 4 > 0 THEN 'host' || (k % 4) END AS host, user_id AS session_id FROM ev WHERE event_type IN ('view', 'signup'))"""
CLICKS = f"""clicks AS (SELECT event_id AS id, ts, {DAY} AS day, '/p/' || (k % 10) AS page, 't' || k AS target, user_id AS session_id, 'l' || (k % 3) AS label, epoch_ms(ts) AS ms FROM ev WHERE event_type = 'click')"""
SUBS = """subs AS (SELECT c_custkey AS id, 'u' || c_custkey || '@example.org' AS key, c_name AS name, 'U' || c_custkey || '@example.org' AS email, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS city,
  c_custkey % 2 = 0 AS offers_optin, CASE WHEN c_custkey % 5 = 0 THEN 'google' ELSE 'manual' END AS signup_method, CASE WHEN c_custkey % 7 > 0 THEN 'tok' || c_custkey END AS unsub_token,
  CASE WHEN c_custkey % 4 > 0 THEN DATE '2024-02-01' - CAST(c_custkey % 3 AS INT) END AS last_emailed, DATE '2024-01-01' AS updated_at FROM customer)"""
PAYLOADS = """payloads AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'new' || o_custkey || '@example.org' ELSE 'u' || o_custkey || '@example.org' END AS key,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'N' || (o_orderkey % 100) END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'C' || (o_orderkey % 10) END AS city,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 2 = 0 END AS offers_optin, CASE WHEN o_orderkey % 6 = 0 THEN 'google' WHEN o_orderkey % 6 = 1 THEN 'manual' END AS signup_method FROM orders)"""
OFFERS = """offers AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS category, '/products/' || p_partkey AS url, p_retailprice / 100 + CAST(p_size AS DOUBLE) / 10 AS pct, CAST(p_size AS DOUBLE) / 50 AS confidence, p_partkey % 17 = 0 AS hit FROM part)"""
