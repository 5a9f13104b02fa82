"""Rates, checks, boards, trends and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import stored
from .selection import medians

ORDER_SLACK, RATIO_TOLERANCE, OUTLIER, LEAST_LIVE = 1.005, 0.015, 0.04, 5
BENCHMARK = {"association": (6_000.0, 20_000.0), "bullion": (8_000.0, 22_000.0), "futures": (60_000.0, 400_000.0)}
LADDER = ("24K", "22K", "18K", "14K")


def canonical_24k(purity: Column, value: Column, includes_gst: Column) -> Column:
    """Price of a gram of pure gold before tax."""
    return S.rounded(value / S.purity_fraction(purity) / F.when(includes_gst, 1 + S.GST).otherwise(1.0))


def rates_from_quotes(quotes: DataFrame, by: list[str]) -> DataFrame:
    """One row per key: the quote of the highest purity (then order), its canonical price and the number of purities.
    quotes: by..., purity, value, includes_gst, seq (breaks ties, highest wins)."""
    best = F.max_by(F.struct("purity", "value", "includes_gst"), F.struct(S.purity_fraction(F.col("purity")), "seq")).alias("q")
    out = quotes.groupBy(*by).agg(best, F.count_distinct("purity").cast("int").alias("purities_found"))
    return out.select(*by, F.col("q.purity").alias("source_purity"), F.col("q.value").alias("source_value"), "purities_found", canonical_24k(F.col("q.purity"), F.col("q.value"), F.col("q.includes_gst")).alias("canonical"))


def ladder(canonical: Column) -> list[Column]:
    return [S.rounded(canonical * S.FRACTION[k]).alias(f"rate_{k.lower()}") for k in LADDER]


def ladder_map(canonical: Column) -> Column:
    return F.map_from_entries(F.array(*(F.struct(F.lit(k), S.rounded(canonical * S.FRACTION[k])) for k in LADDER)))


def ladder_long(rates: DataFrame, keys: list[str]) -> DataFrame:
    return rates.select(*keys, F.explode(ladder_map(F.col("canonical"))).alias("purity", "rate"))


def ordering_sane(values: DataFrame, by: list[str]) -> DataFrame:
    """values: by..., purity, value (one per purity).  sane: no lower purity costs over ORDER_SLACK times the next higher one."""
    known = sorted(S.FRACTION, key=S.FRACTION.get)  # from the lowest
    own = lambda k: F.when(F.col("purity") == k, F.col("value"))
    # numbers of a key in place of sorted rows: a hash aggregation with a fixed row for each key
    ends = [c for k in known for c in (F.max(own(k)).alias(f"__most_{k}"), F.min(own(k)).alias(f"__least_{k}"), F.max(F.when(F.col("purity") == k, 1).otherwise(0)).alias(f"__has_{k}"))]
    ok = F.lit(True)
    for i, k in enumerate(known):
        lower = F.coalesce(*(F.when(F.col(f"__has_{x}") == 1, F.struct(F.col(f"__most_{x}").alias("v"))) for x in reversed(known[:i])))["v"] if i else F.lit(None).cast("double")
        ok = ok & F.coalesce(lower <= F.col(f"__least_{k}") * ORDER_SLACK, F.lit(True))
    return values.groupBy(*by).agg(*ends).select(*by, ok.alias("sane"))


def basis_confirmed(values: DataFrame, by: list[str]) -> DataFrame:
    """confirmed: two purities or more, every pair's ratio within tolerance of the ratio of their fractions.  A page has four
    purities at most, so the pairs are built within the row."""
    rows = values.groupBy(*by).agg(F.collect_list(F.struct(S.purity_fraction(F.col("purity")).alias("f"), F.col("value").alias("v"))).alias("p"))
    off = lambda a, b: F.abs((a["v"] / b["v"]) / (a["f"] / b["f"]) - 1) > RATIO_TOLERANCE
    bad = F.exists("p", lambda a: F.exists("p", lambda b: (a["f"] != b["f"]) & off(a, b)))
    n = F.size("p")
    return rows.select(*by, n.alias("purities"), ((n > 1) & ~bad).alias("confirmed"), F.when(n < 2, "single purity").when(bad, "ratio off").otherwise("ok").alias("note"))


def with_brands(rates: DataFrame, brands: DataFrame) -> DataFrame:
    """Orphans are dropped; Spark broadcasts brands while they are small."""
    return rates.join(brands, "brand_id")


def publishable(rates: DataFrame) -> DataFrame:
    return rates.filter((F.col("status") == "published") & (F.col("canonical") > 0))


def latest_published(rates: DataFrame, as_of: Column, lookback: int | None = 10) -> DataFrame:
    """Rows of the newest published day up to as_of (within lookback days if given)."""
    live = publishable(rates).filter(F.col("rate_date") <= as_of)
    if lookback is not None:
        live = live.filter(F.col("rate_date") >= F.date_sub(as_of, lookback))
    newest = live.agg(F.max("rate_date").alias("rate_date"))  # one row
    return live.join(F.broadcast(newest), "rate_date")


def stats(rows: DataFrame, price: str = "canonical", name: str = "name", by: list[str] | None = None) -> DataFrame:
    """Market statistics of national rows, of all rows where none is national: one row (per key)."""
    by, own = by or [], F.col("national")
    # the median of a group's national rows, and of all its rows
    kinds = F.explode(F.when(own, F.array(F.lit("national"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("__kind")
    mid = medians(rows.select(*by, kinds, F.col(price).alias("__p")), [*by, "__kind"], "__p")
    value = F.coalesce(F.max(F.when(F.col("__kind") == "national", F.col("m"))), F.max(F.when(F.col("__kind") == "all", F.col("m")))).alias("median_24k")
    mid = (mid.groupBy(*by) if by else mid).agg(value)
    pick = lambda f, c: F.coalesce(f(F.when(own, c)), f(c))
    p = F.col(price)
    key = F.struct(p, F.col(name))
    top = F.struct(p, F.col(name))
    agg = [
        pick(F.min, key).alias("low"), pick(F.max, top).alias("high"),
        F.coalesce(F.nullif(F.count_if(own), F.lit(0)), F.count("*")).alias("n"),
    ]
    out = (rows.groupBy(*by) if by else rows).agg(*agg)
    out = out.join(mid, by) if by else out.crossJoin(F.broadcast(mid))  # one row each
    return out.select(
        *by, "median_24k", F.col(f"low.{price}").alias("lowest"), F.col(f"low.{name}").alias("lowest_brand"),
        F.col(f"high.{price}").alias("highest"), F.col(f"high.{name}").alias("highest_brand"), S.rounded(F.col(f"high.{price}") - F.col(f"low.{price}"), 0).alias("spread"), "n",
    )


def market_snapshot(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """stats with the ladder of the unrounded median, rounded last."""
    s = stats(rows, by=by)
    return s.select(*(by or []), *ladder(F.col("median_24k")), *[c for c in s.columns if c not in (by or []) and c != "median_24k"], S.rounded(F.col("median_24k"), 6).alias("median_24k"))


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their place in a total order, counted within ranges of it, so that no task sees them all.  The ranges are stored first: their
    bounds come from a sample and would not be drawn alike twice."""
    parts = stored(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = sizes.select("__range", (F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return parts.withColumn(name, own).join(F.broadcast(before), "__range").withColumn(name, (F.col(name) + F.col("__before")).cast("int")).drop("__range", "__before")


def sorted_board(board: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """A board by any of its columns and in either direction, ranked anew; names without regard to case, nulls last, ties by name."""
    c = F.lower(column) if board.schema[column].dataType.simpleString() == "string" else F.col(column)
    return ranked(board.drop("rank"), c.desc_nulls_last() if descending else c.asc_nulls_last(), F.lower("name"), F.col("name")).orderBy("rank")


def one_row(df: DataFrame) -> DataFrame:
    """A frame that is said to have one row has one at most; several are an error."""
    first = df.limit(2).groupBy().agg(F.count("*").alias("__n"), F.first(F.struct(*df.columns)).alias("__r"))
    return first.filter((F.col("__n") > 0) & F.when(F.col("__n") > 1, F.raise_error(F.lit("one row expected, there are more")).cast("boolean")).otherwise(F.lit(True))).select("__r.*")


def market_board(rows: DataFrame) -> DataFrame:
    """rows of one day: name, canonical, national, states.  Ranked by price, with ladder, difference to the national median and flags."""
    rows = stored(rows, "board")  # read by the statistics, the bounds of the ranges and the ranks
    one = stats(rows)
    joined = ranked(rows, F.col("canonical"), F.col("name")).crossJoin(F.broadcast(one))  # with one row
    delta = S.rounded(F.col("canonical") - F.col("median_24k"))
    return joined.select(
        "rank", "name", "canonical", *ladder(F.col("canonical"))[1:], delta.alias("delta"),
        S.move_class(delta, inclusive=True, names=("high", "low", "par")).alias("level"), ((F.col("canonical") == F.col("lowest")) & (F.col("name") == F.col("lowest_brand"))).alias("is_lowest"),
        (~F.col("national")).alias("regional"), F.when(~F.col("national"), F.array_join("states", "|")).alias("states"),
    )


def serves_area(rows: DataFrame, state: str) -> DataFrame:
    """National brands, and regional ones whose states (an array) hold the state."""
    return rows.filter(F.col("national") | F.array_contains("states", state))


def brand_search(rows: DataFrame, q: str) -> DataFrame:
    return rows.filter(F.contains(F.lower("name"), F.lower(F.trim(F.lit(q)))))


def without_live_rate(brands: DataFrame, live: DataFrame) -> DataFrame:
    return brands.join(live.select("brand_id"), "brand_id", "left_anti")


def placeholder_fill(brands: DataFrame, live: DataFrame, as_of: Column) -> DataFrame:
    """A row of the median, marked estimated, for every brand without a live rate; none where nothing is live."""
    mid = medians(live, [], "canonical").select("m").filter("m is not null")
    rest = without_live_rate(brands, live).crossJoin(F.broadcast(mid))  # with one row at most
    return rest.select("brand_id", as_of.alias("rate_date"), S.rounded(F.col("m")).alias("canonical"), F.lit("estimated").alias("status"), F.lit("reference-median").alias("method"))


def outlier_quarantine(rates: DataFrame, confirmed: str = "confirmed", by: list[str] | None = None) -> DataFrame:
    """drift and status: over OUTLIER off the median and not confirmed, where there are LEAST_LIVE values or more."""
    mid = medians(rates, by or [], "canonical").withColumnRenamed("n", "live")
    out = rates.join(mid, by) if by else rates.crossJoin(F.broadcast(mid))
    drift = S.rounded(F.abs(F.col("canonical") - F.col("m")) / F.col("m"), 4)
    judged = F.col("live") >= LEAST_LIVE
    status = F.when(judged & (F.abs(F.col("canonical") - F.col("m")) / F.col("m") > OUTLIER) & ~F.col(confirmed), "quarantined").otherwise("published")
    return out.withColumn("drift_from_median", F.when(judged, drift)).withColumn("status", status).drop("m", "live")


def daily_trend(rates: DataFrame, as_of: Column, days: int = 120) -> DataFrame:
    live = publishable(rates).filter(F.col("rate_date").between(F.date_sub(as_of, days), as_of))
    return medians(live, ["rate_date"], "canonical").select("rate_date", F.col("m").alias("median_24k"))


def session_moves(trend: DataFrame) -> DataFrame:
    """trend: rate_date, median_24k (a row a day).  move against the day before that has one, and in percent of it."""
    prev = F.lag("median_24k").over(Window.orderBy("rate_date"))  # a row per day
    t = trend.withColumn("prev", prev)
    move = F.col("median_24k") - F.col("prev")
    return t.select("rate_date", "median_24k", "prev", S.rounded(move).alias("move"), S.rounded(S.safe_pct(move, F.col("prev")), 4).alias("pct"))


def recaps(trend: DataFrame, as_of: Column, keep_days: int = 90) -> DataFrame:
    m = session_moves(trend).filter("prev is not null")
    return m.select(
        "rate_date", F.concat(F.lit("gold-rate-recap-"), S.date_slug(F.col("rate_date"))).alias("slug"), S.date_display(F.col("rate_date")).alias("shown"),
        S.rounded(F.col("median_24k")).alias("median_24k"), "move", "pct", S.move_class(F.col("move")).alias("verb"), S.fresh(F.col("rate_date"), as_of, keep_days).alias("fresh"),
    )


def today_move(today: DataFrame, rates: DataFrame, as_of: Column, legacy_base: bool = False) -> DataFrame:
    """today: one row, rate_24k.  Its move against the last day before as_of that has a median: of national brands, or with legacy_base of all
    brands, as older pages have it.  rates: rate_date, canonical, status, national."""
    live = publishable(rates).filter(F.col("rate_date") < as_of)
    base = live if legacy_base else live.filter("national")
    last = medians(base, ["rate_date"], "canonical").agg(F.max_by("m", "rate_date").alias("base"))
    return one_row(today).crossJoin(F.broadcast(last)).select("rate_24k", S.rounded(F.col("base")).alias("base"), S.rounded(F.col("rate_24k") - F.col("base")).alias("move"))


def is_national(brands: DataFrame, regions: DataFrame) -> DataFrame:
    """regions: slug of the brands that sell in some states only, with these.  national: not among them."""
    return brands.join(regions.groupBy("slug").agg(F.array_sort(F.collect_set("state")).alias("states")), "slug", "left").withColumn("national", F.col("states").isNull())


def brand_groups(brands: DataFrame) -> DataFrame:
    """brands: name, active.  How many are active and how many are parked, and how many of them have a page."""
    group = F.when(F.col("active"), "active").otherwise("parked")
    return brands.groupBy(group.alias("brand_group")).agg(F.count("*").alias("brands"), F.count(S.clean_text(F.col("rate_url"))).alias("with_page"))


def newest(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(column)).limit(n)


def daily_place_rows(snapshot: DataFrame, places: DataFrame, moves: DataFrame, day: Column) -> DataFrame:
    """places: place.  Each place with the day's national numbers and today's move (one row each)."""
    both = places.crossJoin(F.broadcast(one_row(snapshot))).crossJoin(F.broadcast(one_row(moves)))
    url = F.concat(F.lit("gold-rate-"), S.slug(F.col("place")), F.lit("-"), S.date_slug(day))
    return both.select("place", url.alias("slug"), "rate_24k", "rate_22k", "rate_18k", "rate_14k", "lowest", "n", "move", S.move_class(F.col("move")).alias("verb"))


def benchmark_gate(value: Column, kind: str) -> Column:
    return value.between(*BENCHMARK[kind])


def premium_board(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """benchmark: one row, bullion.  Premium in rupees and percent, ascending; bar is its share of the largest."""
    j = stored(rows.crossJoin(F.broadcast(one_row(benchmark))).withColumn("premium", F.col("canonical") - F.col("bullion")), "premium")
    j = j.crossJoin(F.broadcast(j.agg(F.max(F.abs("premium")).alias("top"))))  # one row
    pct = S.safe_pct(F.col("premium"), F.col("bullion"))
    bar = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.abs("premium"), F.col("top")), F.lit(0.0))))
    return j.select("name", "canonical", S.rounded(F.col("premium")).alias("premium"), S.rounded(pct).alias("premium_pct"), S.rounded(bar, 4).alias("bar")).orderBy("premium", "name")
