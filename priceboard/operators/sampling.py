"""Samples, interleaving, gates, candidates and firsts per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 600
PROBE = 25


def first_per_key(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key.  Spark prunes row_number limits before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def newest_per_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The newest row of each non-null key; rows without a key are kept."""
    keyed = df.withColumn("__k", key)
    return first_per_key(keyed.filter("__k is not null"), ["__k"], order).unionByName(keyed.filter("__k is null")).drop("__k")


def sample_size(pool: Column) -> Column:
    return F.when(pool >= 500, 150).when(pool >= 100, 60).otherwise(F.greatest(F.lit(20), F.least(pool, F.lit(60))))


def tiered_sample(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first k rows of each group, k by the size of the group; pool and rn stay."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("pool"))
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.join(sizes, by).withColumn("rn", rn).filter(F.col("rn") <= sample_size(F.col("pool")))


def round_robin(df: DataFrame, brand: str, category: str, rn: str = "rn", cap: int = CAP) -> DataFrame:
    """One of each category in turn, to cap rows per brand."""
    turn = F.row_number().over(Window.partitionBy(brand).orderBy(rn, category))
    return df.withColumn("turn", turn).filter(F.col("turn") <= cap)


def probe_gate(df: DataFrame, brand: str, turn: str = "turn", hit: str = "hit", probe: int = PROBE) -> DataFrame:
    """All rows of brands whose first probe rows have a hit (or that have fewer rows); else those first rows only."""
    tried = df.filter(F.col(turn) <= probe).groupBy(brand).agg(F.count("*").alias("__n"), F.count_if(hit).alias("__h"))
    dead = tried.filter((F.col("__n") >= probe) & (F.col("__h") == 0)).select(brand)
    return df.filter(F.col(turn) <= probe).unionByName(df.filter(F.col(turn) > probe).join(dead, brand, "left_anti"))


def top_examples(df: DataFrame, by: list[str], confidence: str, tie: str, k: int = 3) -> DataFrame:
    return first_per_key(df, by, [F.desc(confidence), F.asc(tie)], k)


def candidates(*routes: DataFrame, key: str = "url") -> DataFrame:
    """Rows of all routes, the first of each key by route and place in it.  Each: key, category, place."""
    all_rows = None
    for i, r in enumerate(routes):
        r = r.select(key, "category", F.lit(i).alias("route"), "place")
        all_rows = r if all_rows is None else all_rows.unionByName(r)
    pick = F.min_by(F.struct("category", "route", "place"), F.struct("route", "place", "category")).alias("c")
    return all_rows.groupBy(key).agg(pick).select(key, "c.category", "c.route", "c.place")


def fold_records(df: DataFrame, by: list[str], pct: str, proxied: str) -> DataFrame:
    """Percentages in order, hits and proxied hits of each key."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(pct)).alias("pcts"), F.count(pct).alias("hits"), F.count_if(F.col(proxied)).alias("proxied"))


def profile_report(profiles: DataFrame) -> DataFrame:
    tried = F.col("hits") + F.col("misses")
    return profiles.select("brand", "strategy", "hits", "misses", F.coalesce(F.try_divide(F.col("hits").cast("double"), tried.cast("double")), F.lit(0.0)).alias("hit_rate"))


def updated_profiles(profiles: DataFrame, results: DataFrame) -> DataFrame:
    """results: brand, strategy (null: a miss), at.  Hits and misses added; the brand's strategy becomes its last hit's."""
    new = results.groupBy("brand").agg(
        F.count("strategy").alias("h"), F.count_if(F.col("strategy").isNull()).alias("m"), F.max_by("strategy", F.when(F.col("strategy").isNotNull(), F.col("at"))).alias("s"), F.max(F.when(F.col("strategy").isNotNull(), F.col("at"))).alias("ok")
    )
    p = profiles.join(new, "brand", "full")
    zero = F.lit(0)
    return p.select(
        "brand", F.coalesce("s", "strategy").alias("strategy"), (F.coalesce("hits", zero) + F.coalesce("h", zero)).alias("hits"),
        (F.coalesce("misses", zero) + F.coalesce("m", zero)).alias("misses"), F.coalesce("ok", "last_ok").alias("last_ok"),
    )
