"""More registered queries: sources read back from what sinks wrote, subscriber payloads, streams, boards in any order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import shared_dir
from ..operators import board, extract_rates, pages, pricing, robust, sampling, subscribers
from ..sources import readers, sinks
from ..streaming import jobs
from . import bindings as B
from . import runs
from .bindings import D, table
from .queries import SLUG_SQL, SLUGS, V, _day, _paths, _stream, query


def _at(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _kept(spark, df, name):
    """Where df was written, for a reader."""
    at = _at(spark, name)
    df.write.parquet(at)
    return at


# ---- boards
@query(f"""WITH {B.LIVE} SELECT (row_number() OVER (ORDER BY canonical DESC, lower(name), name))::INT AS rank, name, canonical FROM live""")
def board_by_price_down(spark, sf):
    rows = B.live_rows(spark, sf).select("name", "canonical")
    return board.sorted_board(rows, "canonical", descending=True)


@query(f"""WITH {B.RATES}, {B.BRANDS} SELECT (row_number() OVER (ORDER BY lower(name), name, rate_date))::INT AS place, name, rate_date FROM (SELECT name, min(rate_date) AS rate_date FROM rates JOIN brands USING (brand_id) GROUP BY name)""")
def board_by_name(spark, sf):
    rows = board.with_brands(B.rates(spark, sf), B.brands(spark, sf)).groupBy("name").agg(F.min("rate_date").alias("rate_date"))
    return board.sorted_board(rows, "name").withColumnRenamed("rank", "place")


SHOPS = "shops AS (SELECT s_suppkey AS brand_id, lower(replace(s_name, '#', '-')) AS slug, s_suppkey % 4 > 0 AS active, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE '/rates/' || s_suppkey END AS rate_url, s_nationkey FROM supplier)"


def _shops(spark, sf):
    k = F.col("s_suppkey")
    url = F.when(k % 3 == 1, " ").when(k % 3 == 2, F.concat(F.lit("/rates/"), k.cast("string")))
    return table(spark, sf, "supplier").select(k.alias("brand_id"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"), (k % 4 > 0).alias("active"), url.alias("rate_url"), "s_nationkey")


@query(f"WITH {SHOPS} SELECT CASE WHEN active THEN 'active' ELSE 'parked' END AS brand_group, count(*) AS brands, count(*) FILTER (trim(rate_url) <> '') AS with_page FROM shops GROUP BY 1")
def brand_groups(spark, sf):
    return board.brand_groups(_shops(spark, sf))


@query(f"WITH {SHOPS} SELECT brand_id, slug FROM shops WHERE active")
def brands_active(spark, sf):
    return readers.read_brands(spark, _kept(spark, _shops(spark, sf), "brands"), columns=["brand_id", "slug"])


@query(f"WITH {SHOPS} SELECT slug, n_regionkey <> 2 AS national, CASE WHEN n_regionkey = 2 THEN n_name END AS states FROM shops JOIN nation ON s_nationkey = n_nationkey")
def national_brands(spark, sf):
    shops = _shops(spark, sf)
    nation = table(spark, sf, "nation").filter("n_regionkey = 2")
    regions = shops.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("slug", F.col("n_name").alias("state"))
    return board.is_national(shops, regions).select("slug", "national", F.array_join("states", "|").alias("states"))


def _move_sql(own):
    return f"""WITH {B.RATES}, {B.BRANDS}, {B.PUBLISHED}, m AS (SELECT rate_date, median(canonical) AS m FROM pub JOIN brands USING (brand_id) WHERE rate_date < DATE '{B.AS_OF}' AND {own} GROUP BY 1), l AS (SELECT m FROM m ORDER BY rate_date DESC LIMIT 1)
SELECT 9000.0::DOUBLE AS rate_24k, {D('m')} AS base, {D('9000 - m')} AS move FROM l"""


def _move(spark, sf, legacy):
    rows = board.with_brands(B.rates(spark, sf), B.brands(spark, sf))
    return board.today_move(spark.range(1).select(F.lit(9000.0).alias("rate_24k")), rows, _day(B.AS_OF), legacy)


@query(_move_sql("national"))
def today_move(spark, sf):
    return _move(spark, sf, False)


@query(_move_sql("true"))
def today_move_legacy(spark, sf):
    return _move(spark, sf, True)


@query(f"WITH {B.RATES} SELECT brand_id, rate_date, canonical, {D('canonical * CAST(1.03 AS DOUBLE)')} AS with_tax FROM rates WHERE status = 'published' AND rate_date BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'")
def rates_of_a_month(spark, sf):
    """Read from a table partitioned by day, which prunes partitions."""
    at = _at(spark, "rates")
    sinks.write_rates(B.rates(spark, sf).filter("rate_date between '1995-02-20' and '1995-04-10'"), at)
    r = readers.read_rates(spark, at, since="1995-03-01", status="published").filter(F.col("rate_date") <= _day("1995-03-31"))
    return r.select("brand_id", "rate_date", "canonical", S.rounded(S.with_gst(F.col("canonical"))).alias("with_tax"))


@query(f"WITH {B.RATES} SELECT brand_id, rate_date, canonical, CASE WHEN brand_id % 2 = 0 THEN 'held' ELSE status END AS status FROM rates")
def rates_patched(spark, sf):
    r = B.rates(spark, sf).select("brand_id", "rate_date", "canonical", "status")
    patch = r.filter("brand_id % 2 = 0").select("brand_id", "rate_date", F.lit("held").alias("status"))
    return sinks.patch_rates(r, patch)


@query(f"WITH {SHOPS} SELECT slug, active, CASE WHEN brand_id % 5 = 0 THEN '/seed' ELSE rate_url END AS rate_url FROM shops UNION ALL SELECT 'new-' || n_nationkey, NULL, '/seed' FROM nation")
def brands_seeded(spark, sf):
    shops = _shops(spark, sf)
    seed = shops.filter("brand_id % 5 = 0").select("slug").unionByName(table(spark, sf, "nation").select(F.concat(F.lit("new-"), F.col("n_nationkey").cast("string")).alias("slug")))
    return sinks.merge_brands(shops.select("slug", "active", "rate_url"), seed.withColumn("rate_url", F.lit("/seed")), ["rate_url"])


@query(f"WITH {SHOPS} SELECT brand_id, CASE WHEN trim(rate_url) <> '' THEN trim(rate_url) WHEN brand_id % 2 = 0 THEN '/found/' || brand_id END AS rate_url FROM shops")
def brands_backfilled(spark, sf):
    shops = _shops(spark, sf)
    found = shops.filter("brand_id % 2 = 0").select("brand_id", F.concat(F.lit("/found/"), F.col("brand_id").cast("string")).alias("url"))
    return sinks.backfill_rate_url(shops, found).select("brand_id", "rate_url")


@query(f"""WITH {B.LIVE}, {B.STATS} SELECT DATE '{B.AS_OF}' AS day, {D("m", 6)} AS median_24k, {D("m")} AS rate_24k, {D("m * CAST(0.75 AS DOUBLE)")} AS rate_18k, stats.lowest, stats.lowest_brand, stats.highest, stats.highest_brand, stats.n, name, canonical
FROM live, stats""")
def feed_of_the_day(spark, sf):
    """The day's document, read again: its numbers and its board."""
    rows = B.live_rows(spark, sf)
    body = sinks.rates_feed(rows.select("name", "canonical"), board.market_snapshot(rows), _day(B.AS_OF))
    kind = "struct<date:date,median_24k:double,rate_24k:double,rate_18k:double,lowest:double,lowest_brand:string,highest:double,highest_brand:string,n:bigint,rates:array<struct<name:string,canonical:double>>>"
    read = body.select(F.from_json("body", kind).alias("d"))
    return read.select(F.col("d.date").alias("day"), *(f"d.{c}" for c in ("median_24k", "rate_24k", "rate_18k", "lowest", "lowest_brand", "highest", "highest_brand", "n")), F.inline("d.rates"))


@query(f"""WITH p AS (SELECT p_brand AS name, p_type AS category, CASE WHEN p_size % 2 = 0 THEN '22K' ELSE '18K' END AS karat, p_retailprice AS rate, CAST(p_size AS DOUBLE) AS pct FROM part)
SELECT * FROM p UNION ALL SELECT 'Market median', category, karat, {D('median(rate)')}, {D('median(pct)', 1)} FROM p GROUP BY category, karat""")
def offers_with_median(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("category"), F.when(F.col("p_size") % 2 == 0, "22K").otherwise("18K").alias("karat"), F.col("p_retailprice").alias("rate"), F.col("p_size").cast("double").alias("pct"))
    return runs.with_market_median(p).select("name", "category", "karat", "rate", "pct")


@query(f"""WITH v AS (SELECT p_brand AS name, p_type AS category, CAST(max(p_size) AS DOUBLE) AS pct FROM part WHERE p_partkey % 3 = 0 AND p_brand <> 'Brand#11' GROUP BY ALL), b AS (SELECT DISTINCT p_brand AS name FROM part), m AS (SELECT category, median(pct) AS pct FROM v GROUP BY 1),
o AS (SELECT * FROM v UNION ALL SELECT b.name, m.category, m.pct FROM b, m WHERE b.name NOT IN (SELECT name FROM v)), r AS (SELECT name, category, 6000.0::DOUBLE AS rate, pct FROM o UNION ALL SELECT 'own', category, {D('CAST(5500 AS DOUBLE) / (CAST(22 AS DOUBLE) / 24)', 6)}, 10.0 FROM m),
g AS (SELECT name, category, 100000 / (rate * (1 + greatest(0, least(60, pct)) / 100) * CAST(1.03 AS DOUBLE)) AS g FROM r) SELECT name, category, {D('g', 4)} AS grams, {D('max(g) OVER (PARTITION BY category) - g', 4)} AS deficit FROM g""")
def budget_full(spark, sf):
    p = table(spark, sf, "part")
    offers = p.filter("p_partkey % 3 = 0 and p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("category")).agg(F.max("p_size").cast("double").alias("pct"))
    verified = offers.withColumns({"items": F.lit(1).cast("long"), "confidence": F.lit("high")})
    brands = p.select(F.col("p_brand").alias("name")).distinct()
    medians = verified.groupBy("category").agg(F.median("pct").alias("median_pct"))
    own = medians.select(F.lit("own").alias("name"), "category", S.rounded(pricing.custom_rate(F.lit(5500.0), F.lit("22K")), 6).alias("rate"), F.lit(10.0).alias("pct"))
    return pricing.full_budget_board(verified, brands, medians, brands.withColumn("rate", F.lit(6000.0)), 100_000.0, own)


# ---- sources
@query("SELECT page_id FROM pages WHERE page_id % 4 > 0 AND length(html) > 500")
def pages_saved(spark, sf):
    p = table(spark, sf, "pages").withColumn("status", F.when(F.col("page_id") % 4 == 0, 404).otherwise(200))
    return readers.read_pages(p).select("page_id")


@query("SELECT 'https://shop.example.com/p/' || page_id || '?a=1&b=2' AS loc FROM pages WHERE page_id % 5 < 3")
def sitemap_pages(spark, sf):
    """A root that names three maps of products and two that are not followed."""
    p = table(spark, sf, "pages").withColumn("m", F.col("page_id") % 5)
    pad = "<!-- " + "x" * 130 + " -->"
    loc = F.concat(F.lit("<url><loc><![CDATA[https://shop.example.com/p/"), F.col("page_id").cast("string"), F.lit("?a=1&amp;b=2]]></loc></url>"))
    names = F.when(F.col("m") < 3, F.concat(F.lit("https://shop.example.com/sitemap_products_"), F.col("m").cast("string"), F.lit(".xml"))).otherwise(F.concat(F.lit("https://shop.example.com/sitemap_blogs_"), F.col("m").cast("string"), F.lit(".xml")))
    maps = p.groupBy(names.alias("url")).agg(F.concat(F.lit(pad), F.array_join(F.collect_list(loc), "")).alias("body"))
    root = maps.agg(F.concat(F.lit(pad), F.array_join(F.collect_list(F.concat(F.lit("<loc>"), "url", F.lit("</loc>"))), "")).alias("body")).select(F.lit("https://shop.example.com/sitemap.xml").alias("url"), "body")
    return readers.read_sitemaps(maps.unionByName(root), root.select("url"))


@query("SELECT 'https://' || lower(replace(p_brand, '#', '-')) || '.example.com/products/' || p_partkey AS url, p_name AS title, p_type AS product_type FROM part")
def catalog_products(spark, sf):
    p = table(spark, sf, "part")
    one = F.struct(F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("handle"), F.col("p_type").alias("product_type"))
    origin = F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".example.com"))
    files = p.groupBy(origin.alias("origin"), (F.col("p_partkey") % 7).alias("f")).agg(F.to_json(F.struct(F.collect_list(one).alias("products"))).alias("body"))
    return readers.read_catalog_json(files)


@query("SELECT min(p_partkey)::INT AS place, 'News of ' || p_type || ' & more' AS title, DATE '2024-03-05' AS published FROM part GROUP BY p_type ORDER BY place LIMIT 14")
def news_items(spark, sf):
    """Feeds of one item each; titles that come again are taken once, the first fourteen stay."""
    p = table(spark, sf, "part")
    title = F.concat(F.lit("<item><title><![CDATA[News of "), "p_type", F.lit(" &amp; more - Paper]]></title><link>/n</link><source url='x'>Paper</source><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>"))
    read = readers.read_news_rss(p.select(title.alias("body")).distinct()).select("title", "link", "source", "published").distinct()
    first = p.groupBy(F.concat(F.lit("News of "), "p_type", F.lit(" &amp; more - Paper")).alias("title")).agg(F.min("p_partkey").cast("int").alias("place"))
    return pages.dedupe_news(read.join(first, "title")).select("place", "title", F.to_date("published").alias("published"))


@query("SELECT 'ref' || (page_id % 5) AS name, '22K' AS purity, CAST(9000 + page_id AS DOUBLE) AS value FROM pages WHERE 90000 + page_id * 10 BETWEEN 60000 AND 90300")
def benchmark_values(spark, sf):
    k = F.col("page_id")
    p = table(spark, sf, "pages").select(F.concat(F.lit("ref"), (k % 5).cast("string")).alias("name"), F.concat("html", F.lit("<p>22K per 10 g: Rs "), (90000 + k * 10).cast("string"), F.lit("</p>")).alias("html"))
    patterns = p.select("name").distinct().select("name", F.lit("22K").alias("purity"), F.lit(r"22K per 10 g: Rs (\d+)").alias("pattern"), F.lit(60000.0).alias("low"), F.lit(90300.0).alias("high"), F.lit(10.0).alias("grams"))
    return readers.read_benchmarks(p, patterns)


@query(f"WITH {B.RATES} SELECT brand_id, rate_date, canonical BETWEEN 6000 AND 20000 AS association, canonical BETWEEN 8000 AND 22000 AS bullion, canonical * 10 BETWEEN 60000 AND 400000 AS futures FROM rates")
def benchmark_gates(spark, sf):
    c = F.col("canonical")
    return B.rates(spark, sf).select("brand_id", "rate_date", *(board.benchmark_gate(c * (10 if k == "futures" else 1), k).alias(k) for k in ("association", "bullion", "futures")))


@query("SELECT p_brand AS brand, 'rows' AS strategy, count(*)::INT AS hits, 0::INT AS misses FROM part GROUP BY 1")
def profiles_kept(spark, sf):
    at = _at(spark, "profiles")
    counts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.lit("rows").alias("strategy"), F.count("*").cast("int").alias("hits"), F.lit(0).alias("misses"), F.lit("x").alias("last_ok"))
    sinks.write_profiles(counts, at)
    return readers.read_profiles(spark, at).drop("last_ok")


@query("""WITH p AS (SELECT p_brand AS brand, p_type AS category, '/p/' || p_partkey AS url, CAST(p_size AS DOUBLE) AS pct FROM part),
e AS (SELECT *, count(*) OVER (PARTITION BY brand, category) AS items, row_number() OVER (PARTITION BY brand, category ORDER BY pct DESC, url) AS rn FROM p) SELECT brand, category, items, url, pct FROM e WHERE rn <= 3""")
def charges_document(spark, sf):
    """The document of making charges, written and read again, with its examples."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.concat(F.lit("/p/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_size").cast("double").alias("pct"))
    summary = p.groupBy("brand", "category").agg(F.count("*").alias("items"))
    docs = sinks.making_charges_document(summary, sampling.top_examples(p, ["brand", "category"], "pct", "url").select("brand", "category", "url", "pct"))
    at = _at(spark, "charges")
    sinks.write_json_rows(docs.select(F.concat(F.lit("["), "body", F.lit("]")).alias("body")), at)
    read = readers.flat_charges(spark.read.text(at).withColumnRenamed("value", "body"))
    return read.select("brand", "category", "items", F.inline("examples"))


@query("SELECT '/p/' || o_custkey AS page, count(*) AS clicks FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1 ORDER BY clicks DESC, page LIMIT 30")
def search_aged(spark, sf):
    """Rows of a search report with one key each; aged pages that still have clicks."""
    o = table(spark, sf, "orders").select("o_custkey", F.concat(F.lit("/p/"), F.col("o_custkey").cast("string")).alias("page"))
    rows = readers.read_search_rows(o.select(F.array("page").alias("keys"), F.lit(1).alias("clicks"), F.lit(10).alias("impressions"), F.lit(0.1).alias("ctr"), F.lit(2.0).alias("position")), "page")
    return runs.search_report(rows.withColumn("date", F.lit("2024-01-01")), o.filter("o_custkey % 3 = 0").select("page"))["aged"]


@query(f"{V}, d AS (SELECT * FROM views WHERE id % 3 = 0) SELECT day, count(*) AS views FROM (SELECT day FROM views UNION ALL SELECT day FROM d) GROUP BY 1")
def log_appended(spark, sf):
    """Two batches of events, appended by day and read as a log."""
    v, at = B.views(spark, sf).select("id", "ts", "day", "page"), _at(spark, "log")
    sinks.append_events(v, at)
    sinks.append_events(v.filter("id % 3 = 0"), at)
    log = readers.with_day(spark.read.parquet(at).drop("day"), "ts")
    return log.groupBy("day").agg(F.count("*").alias("views"))


@query("SELECT url AS loc, '<url><loc>' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') || '</loc><lastmod>2024-02-01</lastmod><changefreq>daily</changefreq><priority>0.8</priority></url>' AS xml FROM pages")
def sitemap_elements(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("url").alias("loc"), _day("2024-02-01").alias("lastmod"), F.lit("daily").alias("changefreq"), F.lit(0.8).alias("priority"))
    return sinks.sitemap_xml(rows)


@query("SELECT url AS loc, DATE '2024-01-01' + CAST(page_id % 40 AS INT) AS day FROM pages WHERE page_id % 40 >= 29 ORDER BY day DESC, loc LIMIT 100")
def news_urls(spark, sf):
    """Recaps and daily pages of the last two days, a hundred at most."""
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("loc"), F.lit("t").alias("title"), F.date_add(_day("2024-01-01"), (F.col("page_id") % 40).cast("int")).alias("day"))
    return pages.news_rows(p.filter("page_id % 2 = 0").drop("page_id"), p.filter("page_id % 2 = 1").drop("page_id"), as_of=_day("2024-02-01"), days=2).select("loc", "day")


@query(f"""WITH u AS (SELECT page_id % 5 AS brand, {SLUG_SQL} AS s, page_id FROM pages), f AS (SELECT brand, s AS url, min(page_id) AS place FROM u WHERE contains(s, 'gold') OR contains(s, '22k') GROUP BY ALL)
SELECT * FROM (SELECT brand, url, (CASE WHEN contains(url, 'gold') THEN 1 ELSE 2 END)::INT AS score, (row_number() OVER (PARTITION BY brand ORDER BY (CASE WHEN contains(url, 'gold') THEN 1 ELSE 2 END) DESC, place))::INT AS rank FROM f) WHERE rank <= 3""")
def discovered_top3(spark, sf):
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (F.col("page_id") % 16 + 1).cast("int"))
    found = table(spark, sf, "pages").select((F.col("page_id") % 5).alias("brand"), slug.alias("url"), pages.product_score(slug).alias("score"), F.col("page_id").alias("place"))
    return runs.top_discovered(found).select("brand", "url", "score", "rank")


@query(f"""WITH u AS (SELECT page_id, '/p/' || {SLUG_SQL} AS s FROM pages) SELECT page_id FROM u WHERE (page_id % 3 = 0 AND regexp_matches(s, 'ring|kada')) OR (page_id % 3 = 1 AND (starts_with(s, '/p/gold') OR starts_with(s, '/p/ring'))) OR page_id % 3 = 2""")
def routed_pages(spark, sf):
    """Brands with a pattern, with routes, and with neither."""
    slug = F.element_at(F.array(*map(F.lit, SLUGS)), (F.col("page_id") % 16 + 1).cast("int"))
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://x.example.com/p/"), slug).alias("url"), (F.col("page_id") % 3).cast("string").alias("brand"))
    config = spark.createDataFrame([("0", None, "ring|kada", None), ("1", None, None, ["/p/gold", "/p/ring"]), ("2", None, None, None)], "brand string, require_path string, product_re string, routes array<string>")
    return pages.product_pages(p, config).select("page_id")


@query("SELECT p_brand AS brand, n AS page, CASE WHEN n = 1 THEN '/c/' || p_brand ELSE '/c/' || p_brand || '?page=' || n END AS url FROM (SELECT DISTINCT p_brand FROM part), generate_series(1, 4) AS g(n)")
def listing_urls(spark, sf):
    config = table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    config = config.select("brand", F.array(F.concat(F.lit("/c/"), "brand")).alias("seeds"), F.lit("?page={}").alias("pagination"), F.lit(4).alias("last_page"))
    return pages.listing_pages(config).select("brand", F.col("page").cast("long").alias("page"), "url")


@query("""SELECT s_suppkey, lower(replace(s_name, '#', '-')) || '.example.com' AS domain, 'Ab C' AS place, 'Town ' || s_suppkey AS office, s_suppkey % 2 = 1 AS pin, DATE '2024-01-01' + CAST(s_suppkey % 28 AS INT) AS day,
 CASE WHEN s_suppkey % 2 = 0 THEN '+1.50%' ELSE '-0.25%' END AS pct, '<b>&"' || s_suppkey AS unescaped FROM supplier""")
def text_functions(spark, sf):
    k = F.col("s_suppkey")
    day = F.date_add(_day("2024-01-01"), (k % 28).cast("int"))
    slug = F.concat(F.lit("gold-rate-ab-c-"), S.date_slug(day))
    s = table(spark, sf, "supplier")
    return s.select(
        k.alias("s_suppkey"), S.clean_domain(F.concat(F.lit("https://www."), F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(".Example.com/x"))).alias("domain"), S.place_of_slug(slug).alias("place"),
        S.post_office(F.concat(F.lit("Town "), k.cast("string"), F.when(k % 3 == 0, " S.O").when(k % 3 == 1, " B.O.").otherwise(" GPO"))).alias("office"), S.pin_ok(F.when(k % 2 == 1, "560001").otherwise("056001")).alias("pin"),
        S.date_of_slug(slug).alias("day"), S.signed_pct(F.when(k % 2 == 0, 1.5).otherwise(-0.25)).alias("pct"), S.html_unescape(S.html_escape(F.concat(F.lit('<b>&"'), k.cast("string")))).alias("unescaped"),
    )


# ---- subscribers
@query(f"WITH {B.SUBS} SELECT id, email FROM subs")
def subscribers_deduped(spark, sf):
    """Each second subscriber is there twice; the newer one stays.  Those without an e-mail stay as they are."""
    s = B.subscribers(spark, sf).select("id", "email", "updated_at")
    older = s.filter("id % 2 = 0").withColumns({"updated_at": F.date_sub("updated_at", 5), "email": F.upper("email"), "id": F.col("id") + 1_000_000})
    return subscribers.dedupe_subscribers(s.unionByName(older), _day("2024-02-01")).select("id", "email")


@query(f"WITH {B.SUBS} SELECT id, unsub_token IS NOT NULL AS had, true AS has, NULL::DATE AS last_emailed FROM subs")
def subscribers_reset(spark, sf):
    s = B.subscribers(spark, sf)
    filled = subscribers.fill_tokens(s).withColumn("had", F.col("id") % 7 > 0)
    return subscribers.reset_sends(filled).select("id", "had", F.col("unsub_token").isNotNull().alias("has"), "last_emailed")


@query(f"WITH {B.SUBS} SELECT id, name, email, unsub_token, last_emailed FROM subs")
def subscribers_read(spark, sf):
    return readers.read_subscribers(spark, _kept(spark, B.subscribers(spark, sf), "subscribers"))


LAST = "l AS (SELECT key, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(city, seq) FILTER (city IS NOT NULL) AS city FROM payloads WHERE key IS NOT NULL GROUP BY key)"


@query(f"WITH {B.SUBS}, {B.PAYLOADS}, {LAST} SELECT coalesce(s.key, l.key) AS key, coalesce(l.name, s.name) AS name, coalesce(l.city, s.city) AS city FROM subs s FULL JOIN l ON s.key = l.key")
def subscribers_from_json(spark, sf):
    """Payloads as JSON; fields that are missing stay as stored."""
    raw = B.payloads(spark, sf).select("seq", F.to_json(F.struct("email", "name", "city")).alias("body"))
    target = B.subscribers(spark, sf).select("key", "name", "city", "updated_at")
    return subscribers.upserted(target, raw, "email string, name string, city string", _day("2024-02-01")).select("key", "name", "city")


@query(f"WITH {B.SUBS}, {B.PAYLOADS} SELECT seq, id, unsub_token FROM payloads JOIN subs USING (key)")
def subscriber_tokens(spark, sf):
    return subscribers.tokens_of(B.subscribers(spark, sf), B.payloads(spark, sf))


# ---- streams
@query("SELECT user_id AS id, CAST(ts AS DATE) AS day, 1::BIGINT AS sends FROM events WHERE event_type = 'click' GROUP BY ALL")
def stream_sends(spark, sf):
    """One send of each subscriber and day."""
    out, at = _paths(spark, "sends")
    e = _stream(spark, sf, "events").filter("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.to_table(jobs.once_a_day(e), out, at)
    return spark.read.parquet(out).groupBy("id", "day").agg(F.count("*").alias("sends"))


# ---- distances in characters
GAPS = {
    "labeled": (35, "<p>22 KT{}Rs. %d /gm</p>"), "value_karat": (40, "<p>%d INR/gms{}22k (916)</p>"), "value_ct": (80, "<p>Rs %d{}/Gram (22ct)</p>"),
    "value_per_gm": (40, "<p>Rate is Rs.%d per gm{}(22kt)</p>"), "headline": (80, "<p>22Kt Gold Rate{}1 G ₹%d</p>"),
}
GAP_SQL = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(GAPS))
MOST_SQL = " ".join(f"WHEN {i} THEN {most}" for i, (most, _) in enumerate(GAPS.values()))


@query(f"""SELECT p_partkey AS page_id, CASE p_partkey % 5 {GAP_SQL} END AS extractor, '22K' AS purity, CAST(9000 + p_partkey % 900 AS DOUBLE) AS value, 1::BIGINT AS n FROM part
WHERE p_partkey // 5 % 100 + 2 <= CASE p_partkey % 5 {MOST_SQL} END""")
def text_gaps(spark, sf):
    """A page for each part, with a gap of 2 to 101 characters between the purity and the price: those within the rule's distance are read."""
    k = F.col("p_partkey")
    fill = F.concat(F.lit(" "), F.rpad(F.lit(""), F.floor(k / 5) % 100, "x"), F.lit(" "))
    layout = F.element_at(F.array(*(F.lit(x) for _, x in GAPS.values())), (k % 5 + 1).cast("int"))
    html = F.replace(F.replace(layout, F.lit("%d"), (9000 + k % 900).cast("string")), F.lit("{}"), fill)
    return extract_rates.extract_rates(table(spark, sf, "part").select(k.alias("page_id"), html.alias("html")), {n: extract_rates.EXTRACTORS[n] for n in GAPS})


# ---- XML documents and the archive
URLS = "u AS (SELECT page_id, 'https://shop.example.com/p/' || page_id || '?a=1&b=<' || page_id || '>' AS loc FROM pages)"


def _urls(spark, sf):
    k = F.col("page_id").cast("string")
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://shop.example.com/p/"), k, F.lit("?a=1&b=<"), k, F.lit(">")).alias("loc"))


@query(f"WITH {URLS} SELECT loc, DATE '2024-01-01' + CAST(page_id % 28 AS INT) AS lastmod, CASE WHEN page_id % 2 = 0 THEN 'daily' ELSE 'monthly' END AS changefreq, CAST(page_id % 10 AS DOUBLE) / 10 AS priority FROM u")
def sitemap_files(spark, sf):
    """urlset documents, written and read back."""
    k, at = F.col("page_id"), _at(spark, "sitemap")
    rows = _urls(spark, sf).select("loc", F.date_add(_day("2024-01-01"), (k % 28).cast("int")).alias("lastmod"), F.when(k % 2 == 0, "daily").otherwise("monthly").alias("changefreq"), ((k % 10) / 10).alias("priority"))
    sinks.write_sitemap(rows, at)
    return readers.read_sitemap_files(spark, at)


@query(f"WITH {URLS} SELECT loc FROM u")
def sitemap_nested(spark, sf):
    """Documents that the writers made, found from an index of their names; with a root of prefixed names, CDATA and attributes beside them."""
    at, index = _at(spark, "sitemap"), _at(spark, "index")
    u = _urls(spark, sf)
    sinks.write_sitemap(u.filter("page_id % 2 = 0").select("loc", _day("2024-01-01").alias("lastmod"), F.lit("daily").alias("changefreq"), F.lit(0.5).alias("priority")).repartition(3), at)
    files = spark.read.format("binaryFile").load(at).select(F.concat(F.lit("https://shop.example.com/sitemap_"), F.regexp_extract("path", "[^/]+$", 0)).alias("url"), F.decode("content", "UTF-8").alias("body"))
    files = files.withColumn("url", F.regexp_replace("url", r"(\.xml)?$", ".xml"))
    prefixed = F.concat(F.lit('<?xml version="1.0"?><!-- '), F.lit("x" * 120), F.lit(' --><s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="http://www.example.com/image"><s:url id="1"><s:loc lang="en"><![CDATA['), "loc", F.lit("]]></s:loc><i:image><i:loc>https://no.example.com/x</i:loc></i:image></s:url></s:urlset>"))
    other = u.filter("page_id % 2 = 1").select(F.concat(F.lit("https://shop.example.com/sitemap_"), "page_id", F.lit(".xml")).alias("url"), prefixed.alias("body"))
    every = files.unionByName(other)
    sinks.write_sitemap_index(every.select(F.col("url").alias("loc")), index)
    root = spark.read.format("binaryFile").load(index).select(F.lit("https://shop.example.com/sitemap.xml").alias("url"), F.decode("content", "UTF-8").alias("body"))
    return readers.read_sitemaps(every.unionByName(root), root.select("url"))


@query("""SELECT page_id AS feed, n::INT AS place, 'Item ' || n || ' & more of ' || page_id AS title, 'https://n.example.com/' || page_id || '?i=' || n || '&x=1' AS link, CASE WHEN n = 0 THEN 'Paper' END AS source,
 DATE '2024-03-05' AS published FROM pages, generate_series(0, 2) g(n)""")
def news_feeds(spark, sf):
    """Feeds of three items each: attributes, CDATA, entities, other elements; every third one is no XML document."""
    k = F.col("page_id").cast("string")
    item = lambda n, title: F.concat(F.lit(f'<item a="1"><title>{title[0]}Item {n} {title[1]} more of ' if n else f"<item><title>{title[0]}Item {n} {title[1]} more of "), k, F.lit(f"{title[2]}</title><link>https://n.example.com/"), k, F.lit(f"?i={n}&amp;x=1</link>" + ('<source url="https://p.example.com">Paper</source>' if n == 0 else "") + "<pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>"))
    plain, cdata = ("", "&amp;", ""), ("<![CDATA[", "&", "]]>")
    body = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:d="http://www.example.com/d"><channel><title>All</title><d:x>1</d:x>'), item(0, plain), item(1, cdata), item(2, plain), F.lit("</channel></rss>"))
    loose = F.concat(F.lit("<p>"), item(0, cdata), item(1, plain).substr(F.lit(1), F.lit(10_000)), item(2, plain))
    loose = F.replace(loose, F.lit('<item a="1">'), F.lit("<item>"))
    feeds = table(spark, sf, "pages").select(F.col("page_id").alias("feed"), F.when(F.col("page_id") % 3 == 0, loose).otherwise(body).alias("body"))
    return readers.read_news_rss(feeds).withColumn("published", F.to_date("published"))


@query("SELECT page_id, DATE '2024-01-01' + CAST(page_id % 300 AS INT) AS day, CASE page_id % 2 WHEN 0 THEN 'Navi Mumbai' ELSE 'Pune' END AS place, length(html) AS characters FROM pages")
def page_archive(spark, sf):
    """A file for each page, in the folder of its place and day, read back with what the file system says."""
    k, at = F.col("page_id"), _at(spark, "archive")
    day = F.date_add(_day("2024-01-01"), (k % 300).cast("int"))
    name = F.concat(F.lit("gold-rate-"), F.when(k % 2 == 0, "navi-mumbai").otherwise("pune"), F.lit("-"), S.date_slug(day), F.lit(".html"))
    html = F.concat(F.lit("p"), k.cast("string"), F.lit("/"), F.translate("html", "\n\r", "  "))
    readers.write_page_archive(table(spark, sf, "pages").select(name.alias("name"), html.alias("html")), at)
    a = readers.read_page_archive(spark, at).filter("bytes > 0 AND saved IS NOT NULL")
    text = F.regexp_replace("html", "\n$", "")
    return a.select(F.regexp_extract("html", r"^p(\d+)/", 1).cast("long").alias("page_id"), "day", "place", F.length(F.regexp_replace(text, r"^p\d+/", "")).cast("long").alias("characters"))


# ---- the making-charge dashboard
DASH = f"""{B.LIVE}, of AS (SELECT s_name AS brand, p_type AS category, p_retailprice / 100 + CAST(p_size AS DOUBLE) / 10 AS pct FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)),
m0 AS (SELECT brand, category, median(pct) AS md, count(*) AS n FROM of GROUP BY ALL), d0 AS (SELECT of.*, md, n, abs(pct - md) AS dv FROM of JOIN m0 USING (brand, category)), a0 AS (SELECT brand, category, median(dv) AS mad FROM d0 GROUP BY ALL),
k0 AS (SELECT d0.*, CASE WHEN n < 4 OR mad = 0 THEN true ELSE abs(CAST(0.6745 AS DOUBLE) * (pct - md) / mad) <= CAST(3.5 AS DOUBLE) END AS kept FROM d0 JOIN a0 USING (brand, category)),
su0 AS (SELECT brand, category, count(*) FILTER (kept) AS items, {D('median(pct) FILTER (kept)', 1)} AS median_pct FROM k0 GROUP BY ALL),
prices AS (SELECT l.name, s.category, v.karat, {D('l.canonical * v.f')} AS rate, s.median_pct AS pct, s.items, CASE WHEN items >= 12 THEN 'high' WHEN items >= 5 THEN 'medium' WHEN items > 0 THEN 'low' ELSE 'none' END AS confidence
  FROM live l JOIN su0 s ON s.brand = l.name, (VALUES ('24K', CAST(1 AS DOUBLE)), ('22K', CAST(22 AS DOUBLE) / 24), ('18K', CAST(0.75 AS DOUBLE))) v(karat, f)),
sc0 AS (SELECT o_orderkey AS scenario, (SELECT list(DISTINCT p_type ORDER BY p_type) FROM part)[o_orderkey % 6 + 1] AS category, ['24K', '22K', '18K'][o_orderkey % 3 + 1] AS karat, CAST(1 + o_orderkey % 20 AS DOUBLE) AS weight FROM orders),
costs AS (SELECT scenario, name, rate, pct, {D('(weight * rate + weight * rate * pct / 100) * CAST(1.03 AS DOUBLE)')} AS total FROM sc0 JOIN prices USING (category, karat))"""


def _dashboard(spark, sf):
    suppliers = table(spark, sf, "supplier")
    p = table(spark, sf, "part").crossJoin(F.broadcast(suppliers.agg(F.count("*").alias("n"))))  # one row
    of = p.join(suppliers, F.col("s_suppkey") == F.col("p_partkey") % F.col("n")).select(F.col("s_name").alias("brand"), F.col("p_type").alias("category"), (F.col("p_retailprice") / 100 + F.col("p_size") / 10).alias("pct"))
    kinds = table(spark, sf, "part").agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))  # a few categories
    k = F.col("o_orderkey")
    karat = F.get(F.array(*map(F.lit, runs.KARATS)), (k % 3).cast("int"))
    scenarios = table(spark, sf, "orders").crossJoin(F.broadcast(kinds)).select(k.alias("scenario"), F.get("kinds", (k % 6).cast("int")).alias("category"), karat.alias("karat"), (1 + k % 20).cast("double").alias("weight"))
    return runs.making_dashboard(B.live_rows(spark, sf), robust.summarize(of, ["brand", "category"], "pct"), scenarios, 100_000.0)


@query(f"WITH {DASH} SELECT * FROM prices")
def dashboard_prices(spark, sf):
    """Charges of parts by their supplier, with the supplier's live ladder from lineitem."""
    return _dashboard(spark, sf)["prices"]


@query(f"""WITH {DASH}
SELECT scenario, min_by(name, (rate, name)) AS least_rate_brand, min_by(name, (total, name)) AS least_total_brand, {D('min_by(total, (rate, name)) - min(total)')} AS extra_cost FROM costs GROUP BY scenario""")
def dashboard_traps(spark, sf):
    return _dashboard(spark, sf)["traps"]
