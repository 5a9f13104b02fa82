"""The daily runs as compositions: rates from pages, making charges from pages, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables
from ..operators import board, extract_making, extract_rates, pricing, robust, sampling, search
from ..operators.selection import medians
from ..sources import sinks


def rates_run(pages: DataFrame, brands: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """pages: page_id (the brand's), html; brands: brand_id, includes_gst; stored: brand_id, rate_date, canonical, status, method, seq.
    Extract, check, normalise, merge, quarantine, fill: a row per brand for the day."""
    found = tables.stored(extract_rates.extract_rates(pages), "rates")
    ok = extract_rates.accept_rates(pages, found).filter("verdict = 'ok'").select("page_id")
    good = found.join(ok, "page_id").withColumnRenamed("page_id", "brand_id").join(brands.select("brand_id", "includes_gst"), "brand_id")
    confirmed = board.basis_confirmed(good, ["brand_id"]).select("brand_id", "confirmed")
    new = tables.stored(board.rates_from_quotes(good.withColumn("seq", F.lit(0)), ["brand_id"]).join(confirmed, "brand_id"), "rates")
    judged = board.outlier_quarantine(new)
    rows = judged.select("brand_id", as_of.alias("rate_date"), "canonical", "status", F.lit("extracted").alias("method"), F.lit(1).cast("long").alias("seq"))
    merged = tables.stored(sinks.merge_rates(stored, rows, seq="seq").filter(F.col("rate_date") == as_of), "rates")
    fill = board.placeholder_fill(brands, merged, as_of)
    return merged.drop("seq").unionByName(fill.select("brand_id", "rate_date", "canonical", "status", "method"))


def charges_run(pages: DataFrame, profiles: DataFrame, previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """pages: page_id, brand, category, url, html.  Sample, interleave, extract, fold, summarise, compare; and the profiles after the run."""
    # the sample is drawn from the keys, and only its pages are read
    keys = pages.select("page_id", "brand", "category", "url")
    sample = tables.stored(sampling.round_robin(sampling.tiered_sample(keys, ["brand", "category"], "page_id"), "brand", "category"), "sample")
    got = extract_making.extract_making(pages.join(sample.select("page_id"), "page_id", "left_semi"), profiles)
    read = tables.stored(sample.join(got, "page_id", "left"), "read")
    hits = read.filter("making_pct is not null")
    summary = robust.summarize(hits, ["brand", "category"], "making_pct")
    out = {
        "summary": summary, "examples": sampling.top_examples(hits, ["brand", "category"], "confidence", "page_id").select("brand", "category", "url", F.col("making_pct").alias("pct")),
        "profiles": sampling.updated_profiles(profiles, read.select("brand", "strategy", F.lpad(F.col("turn").cast("string"), 9, "0").alias("at"))),
    }
    return out if previous is None else out | {"drift": robust.drift(summary, previous, ["brand", "category"])}


def search_report(rows: DataFrame, aged: DataFrame) -> dict[str, DataFrame]:
    """rows: date, page, clicks, impressions, position."""
    return {"trend": search.trend(rows), "groups": search.groups(rows), "top": search.top_pages(rows), "aged": search.top_aged(rows, aged)}


def with_market_median(prices: DataFrame) -> DataFrame:
    """prices: name, category, karat, rate, pct; adds the median of each category and karat under a name of its own."""
    rate, pct = (medians(prices, ["category", "karat"], c).drop("n").withColumnRenamed("m", c) for c in ("rate", "pct"))
    mid = rate.join(pct, ["category", "karat"]).select("category", "karat", S.rounded(F.col("rate")).alias("rate"), S.rounded(F.col("pct"), 1).alias("pct"))
    return prices.unionByName(mid.withColumn("name", F.lit("Market median")))


def top_discovered(found: DataFrame, k: int = 3) -> DataFrame:
    """found: brand, url, score, place.  The k best URLs of each brand with a score above zero; a URL counts where it came first."""
    first = found.filter("score > 0").groupBy("brand", "url").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    w = Window.partitionBy("brand").orderBy(F.desc("score"), "place", "url")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: The karats that the dashboard prices.
KARATS = ["24K", "22K", "18K"]


def making_dashboard(live: DataFrame, summaries: DataFrame, scenarios: DataFrame, budget: float) -> dict[str, DataFrame]:
    """live: name, canonical (the day's rates); summaries: brand, category, median_pct, items, confidence; scenarios: scenario, category, karat, weight.
    Charges meet the live ladder by the brand's name: brands without a rate or without charges are not priced.  prices: a row per brand, category and karat; costs: what
    each scenario costs at each brand; traps: where the least rate is not the least total; grams: what the budget buys."""
    ladder = board.ladder_long(live, ["name"]).filter(F.col("purity").isin(KARATS)).select("name", F.col("purity").alias("karat"), "rate")
    charges = summaries.select(F.col("brand").alias("name"), "category", F.col("median_pct").alias("pct"), "items", "confidence")
    prices = tables.stored(ladder.join(charges, "name"), "dashboard")
    return {"prices": prices, "costs": pricing.scenario_costs(scenarios, prices), "traps": pricing.scenario_traps(scenarios, prices), "grams": pricing.budget_board(prices.filter("karat = '22K'"), budget)}
