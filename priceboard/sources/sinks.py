"""Sinks: keyed merges as DataFrames, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def align_to_schema(df: DataFrame, target: DataFrame) -> DataFrame:
    """target's columns: those df has, cast, the others null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema))


def merge_rates(target: DataFrame, new: DataFrame, seq: str = "scraped_at", keys=("brand_id", "rate_date")) -> DataFrame:
    """The latest row of each key; rows of new without a price (a failed extraction) keep what is stored.  Partial maxima before the
    shuffle, so many revisions of one key cost no more than one."""
    ok = new.filter(F.col("canonical").isNotNull())
    both = target.withColumn("__new", F.lit(0)).unionByName(align_to_schema(ok, target).withColumn("__new", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, "__new", *[c for c in rest if c != seq])).alias("r"))
    return best.select(*keys, "r.*").select(*target.columns)


def write_rates(rates: DataFrame, path: str) -> None:
    """Overwrites the days it holds and no others.  A day's rows are gathered first, so that not every task writes a file for every day; large days are split."""
    rates.hint("rebalance", "rate_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rate_date").parquet(path)


def last_of_key(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row of each key: the greatest in order, and of equal ones that of the greatest columns."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), *rest)).alias("__r")
    return df.groupBy(*keys).agg(best).select(*keys, "__r.*").select(*df.columns)


def merge_brands(target: DataFrame, seed: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """Full outer on slug: listed columns of the seed win where it has them, other rows are added.  Of several seed rows of a slug the last in order counts."""
    seed = last_of_key(seed, ["slug"], order)
    t, s = target.alias("t"), seed.alias("s")
    out = [F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) if c in columns else F.col(f"t.{c}").alias(c) for c in target.columns if c != "slug"]
    return t.join(s, "slug", "full").select("slug", *out)


def backfill_rate_url(brands: DataFrame, found: DataFrame) -> DataFrame:
    """found: brand_id, url.  Set only where the brand had none."""
    return brands.join(found.groupBy("brand_id").agg(F.min("url").alias("__u")), "brand_id", "left").withColumn("rate_url", F.coalesce(S.clean_text(F.col("rate_url")), "__u")).drop("__u")


def patch_rates(rates: DataFrame, patch: DataFrame, columns=("drift_from_median", "status", "basis_note"), order: str | None = None) -> DataFrame:
    """patch: the keys and some columns, which replace the stored ones.  Of several patches of a key the last in order counts."""
    own = [c for c in columns if c in patch.columns]
    patch = last_of_key(patch, ["brand_id", "rate_date"], order)
    p = patch.select("brand_id", "rate_date", *(F.col(c).alias(f"__{c}") for c in own), F.lit(True).alias("__p"))
    j = rates.join(p, ["brand_id", "rate_date"], "left")
    return j.select(*(F.when(F.col("__p"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in rates.columns))


def making_charges_document(summaries: DataFrame, examples: DataFrame) -> DataFrame:
    """One row of JSON per brand: categories sorted, up to three examples each."""
    ex = examples.groupBy("brand", "category").agg(F.array_sort(F.collect_list(F.struct("url", "pct"))).alias("examples"))
    j = summaries.join(ex, ["brand", "category"], "left")
    cats = F.array_sort(F.collect_list(F.struct(*[c for c in j.columns if c != "brand"])))
    return j.groupBy("brand").agg(cats.alias("categories")).select("brand", F.to_json(F.struct("brand", "categories")).alias("body"))


def rates_feed(board: DataFrame, snapshot: DataFrame, day: Column) -> DataFrame:
    """The day's document: headline numbers and the board in rank order, as one row of JSON."""
    rows = board.agg(F.array_sort(F.collect_list(F.struct(*board.columns))).alias("rates"))
    return snapshot.crossJoin(F.broadcast(rows)).select(F.to_json(F.struct(day.alias("date"), *snapshot.columns, "rates")).alias("body"))


def write_json_rows(df: DataFrame, path: str, body: str = "body") -> None:
    df.select(F.col(body).alias("value")).write.mode("overwrite").text(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.sort("brand").write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str, checkpoint: str | None = None):
    """Insert-only, partitioned by day; a stream is written until what is there is in."""
    if events.isStreaming:
        return events.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return events.write.mode("append").partitionBy("day").parquet(path)


def sitemap_xml(rows: DataFrame) -> DataFrame:
    """A <url> element per row (loc, lastmod, changefreq, priority)."""
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    return rows.select("loc", F.concat(F.lit("<url>"), tag("loc", S.html_escape(F.col("loc"))), tag("lastmod", F.date_format("lastmod", "yyyy-MM-dd")), tag("changefreq", F.col("changefreq")), tag("priority", F.format_string("%.1f", "priority")), F.lit("</url>")).alias("xml"))


#: The namespace of sitemaps and how many URLs a file may hold.
SITEMAP_NAMESPACE, SITEMAP_URLS = "http://www.sitemaps.org/schemas/sitemap/0.9", 50_000


def write_sitemap(rows: DataFrame, path: str) -> None:
    """rows: loc, lastmod, changefreq, priority.  urlset documents of SITEMAP_URLS at most, one a file."""
    url = rows.select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), "changefreq", F.format_string("%.1f", "priority").alias("priority"))
    url.write.mode("overwrite").format("xml").option("rootTag", f'urlset xmlns="{SITEMAP_NAMESPACE}"').option("rowTag", "url").option("maxRecordsPerFile", SITEMAP_URLS).save(path)


def write_sitemap_index(locations: DataFrame, path: str) -> None:
    """locations: loc.  One sitemapindex document; a row for each file of write_sitemap."""
    locations.select("loc").coalesce(1).write.mode("overwrite").format("xml").option("rootTag", f'sitemapindex xmlns="{SITEMAP_NAMESPACE}"').option("rowTag", "sitemap").save(path)
