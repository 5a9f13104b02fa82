"""Pages and their URLs: filters, categories, links, ageing, sitemap rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Metals and stones that exclude a URL as whole words, words that a product's score loses by, categories with their words in order.
OTHER_METALS = ["silver", "platinum", "titanium", "steel"]
STONES = [
    "diamond", "diamonds", "solitaire", "studded", "gemstone", "gemstones", "kundan", "polki", "pearl", "pearls", "ruby", "rubies", "emerald", "emeralds", "sapphire", "sapphires", "americandiamond",
    "cz", "zircon", "zirconia", "topaz", "garnet", "onyx", "opal", "turquoise", "moissanite", "navratna", "navratra", "stone", "stones", "gem", "gems",
]
PENALTY = ["diamond", "platinum", "silver", "solitaire", "gemstone", "pearl"]
CATEGORIES = [("Mangalsutra", ["mangalsutra"]), ("Earrings", ["earring", "jhumk", "stud"]), ("Bangle", ["bangle", "kada"]), ("Ring", ["ring"])]
AGED_FROM, AGED_TO = "index, follow", "noindex, follow"


def _words(text: Column) -> Column:
    """The words of a text: letters, digits and underscores."""
    return F.split(F.lower(text), "[^a-z0-9_]+")


def _any(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def is_plain_gold(url: Column) -> Column:
    return ~F.arrays_overlap(_words(url), _any(OTHER_METALS + STONES))


def categorize(url: Column, categories=CATEGORIES, word_bounded: bool = False) -> Column:
    """First category, in order, one of whose words occurs in the URL (an earring before a ring); null for other metals and stones."""
    low, chain = F.lower(url), None
    for name, keys in categories:
        hit = F.arrays_overlap(_words(url), _any([k + s for k in keys for s in ("", "s")])) if word_bounded else F.exists(_any(keys), lambda k: F.contains(low, k))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return F.when(is_plain_gold(url), chain)


def product_pages(pages: DataFrame, config: DataFrame) -> DataFrame:
    """config: brand, require_path (null: any), and if it has them product_re (a pattern that a product's URL meets; null: any) and
    routes (array of path prefixes; null: any).  Pages whose URL their brand's configuration takes."""
    own = [c for c in ("require_path", "product_re", "routes") if c in config.columns]
    j = pages.join(config.select("brand", *own), "brand")
    take = {
        "require_path": lambda c: F.contains("url", c), "product_re": lambda c: F.regexp_like(F.col("url"), c),
        "routes": lambda c: F.exists(c, lambda r: F.regexp_replace("url", r"^https?://[^/]+", "").startswith(r)),
    }
    for c in own:
        j = j.filter(F.col(c).isNull() | take[c](F.col(c)))
    return j.drop(*own)


def listing_pages(config: DataFrame, most: int = 50) -> DataFrame:
    """config: brand, seeds (array of URLs), pagination (a suffix with {} for the number; null: one page), last_page.  The URLs to list, in order;
    at most ``most`` pages of each seed are meant to be listed, and a larger last_page is an error of the configuration."""
    seeds = config.select("brand", F.posexplode("seeds").alias("seed", "url"), "pagination", F.coalesce("last_page", F.lit(1)).alias("last"))
    seeds = seeds.withColumn("last", F.when(F.col("last") <= most, F.col("last")).otherwise(F.raise_error(F.lit(f"last_page above {most}")).cast("int")))
    pages = seeds.select("brand", "seed", "url", "pagination", F.explode(F.sequence(F.lit(1), F.when(F.col("pagination").isNull(), 1).otherwise(F.col("last")))).alias("page"))
    paged = F.concat("url", F.replace("pagination", F.lit("{}"), F.col("page").cast("string")))
    return pages.select("brand", "seed", "page", F.when((F.col("page") == 1) | F.col("pagination").isNull(), F.col("url")).otherwise(paged).alias("url"))


def product_score(text: Column) -> Column:
    """Points for coins and bars, for 24 and 22 karat and for gold; fewer where a word of PENALTY occurs."""
    low, words = F.lower(text), _words(text)
    has = lambda *parts: F.exists(_any(list(parts)), lambda k: F.contains(low, k))
    points = [
        (F.arrays_overlap(words, _any(["coin", "coins", "bar", "bars"])), 3), (has("24k", "24-k", "24 k"), 2), (has("22k", "22-k", "22 k"), 2), (has("gold"), 1), (has(*PENALTY), -3),
    ]
    return sum((F.when(hit, n).otherwise(0) for hit, n in points), F.lit(0))


def links(pages: DataFrame, pattern: str = r'href="([^"#?]+)"') -> DataFrame:
    """page_id, url: distinct absolute links of each page."""
    found = pages.select("page_id", F.col("url").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("href"))
    origin = F.regexp_extract("at", r"^https?://[^/]+", 0)
    h = F.col("href")
    return found.select("page_id", F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(origin, F.lit("/"), h)).alias("url"))


def robots_meta(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'(?i)<meta\s+name="robots"\s+content="([^"]*)"', 1), F.lit(""))


def age_out(pages: DataFrame, day: str, cutoff: Column) -> DataFrame:
    """Pages older than cutoff get a noindex robots tag: changed where there is one, else put after the viewport tag; without
    either the page stays.  Running it again changes nothing."""
    html = F.col("html")
    tag = r'(?is)\A(.*?<meta\s+name="robots"\s+content=")[^"]*(")'
    view = r'(?is)\A(.*?<meta\s+name="viewport"[^>]*>)'
    patched = F.when(robots_meta(html).isNotNull(), F.regexp_replace(html, tag, f"$1{AGED_TO}$2")).when(html.rlike(view), F.regexp_replace(html, view, f'$1<meta name="robots" content="{AGED_TO}">')).otherwise(html)
    return pages.withColumn("html", F.when(F.col(day) < cutoff, patched).otherwise(html))


def sitemap_rows(static: DataFrame, dated: DataFrame, as_of: Column, days: int) -> DataFrame:
    """static: loc, changefreq, priority; dated: loc, day.  Only fresh dated pages are listed."""
    own = static.select("loc", as_of.alias("lastmod"), "changefreq", "priority")
    live = dated.filter(S.fresh(F.col("day"), as_of, days)).select("loc", F.col("day").alias("lastmod"), F.lit("monthly").alias("changefreq"), F.lit(0.5).alias("priority"))
    return own.unionByName(live)


def news_rows(*parts: DataFrame, as_of: Column, days: int = 2, most: int = 100) -> DataFrame:
    """Each: loc, title, day."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.filter(S.fresh(F.col("day"), as_of, days)).orderBy(F.desc("day"), "loc").limit(most)


def dedupe_news(items: DataFrame, most: int = 14) -> DataFrame:
    """items: feed (0 where it is missing), place, title, source, link, published.  First item of each title, in the order of feeds and of places in them; ties by link."""
    if "feed" not in items.columns:
        items = items.withColumn("feed", F.lit(0))
    t = items.withColumn("title", S.headline(S.html_unescape(F.col("title")), F.col("source"))).filter("title is not null")
    first = t.groupBy(F.lower("title").alias("k")).agg(F.min_by(F.struct("feed", "place", "title", "source", "link", "published"), F.struct("feed", "place", "link", "title")).alias("r"))
    return first.select("r.*").orderBy("feed", "place", "link").limit(most)
