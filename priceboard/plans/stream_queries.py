"""Registered queries of streams: merges into stored tables, visitors, and states that end."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import stored
from ..operators import board, subscribers
from ..sources import readers, sinks
from ..streaming import jobs
from ..streaming.store import Store, by_hash, by_month, snapshot_step
from . import bindings as B
from .bindings import D
from .more_queries import LAST, _at
from .queries import V, SQL, _day, query


def _files(spark, df, name, n=3, parts=1):
    """df as a stream of n batches of so many files, which are written by as many tasks."""
    at = _at(spark, name)
    df.repartition(n * parts).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", parts).parquet(at)


@query(SQL["rates_merge"])
def stream_rates_merge(spark, sf):
    """Quotes of half of all lines are stored; the others come in three batches, each rewriting the months it touches."""
    q = B.quotes(spark, sf)
    v = q.select("brand_id", "rate_date", F.when(F.col("l_tax") >= 0.01, board.canonical_24k(F.col("purity"), F.col("value"), F.col("includes_gst"))).alias("canonical"), "seq")
    store, at = Store(_at(spark, "rates"), by_month("rate_date")), _at(spark, "checkpoint")
    store.begin(sinks.merge_rates(v.limit(0), v.filter("seq % 20 < 10"), seq="seq"))
    merge = lambda old, new: sinks.merge_rates(old, new, seq="seq")
    jobs.for_each_batch(_files(spark, v.filter("seq % 20 >= 10"), "quotes", parts=8), at, store.step(merge, at)).awaitTermination()
    return store.read(spark)


@query(f"WITH {B.RATES}, {B.PUBLISHED} SELECT rate_date, {D('median(canonical)', 4)} AS median_24k, count(*) AS n FROM pub GROUP BY 1")
def stream_snapshots(spark, sf):
    """Rates of a third of the brands are stored, with their snapshots; the others are merged batch by batch, and the snapshots of the days that a batch touches made anew."""
    r = stored(B.rates(spark, sf).filter("status = 'published' and canonical > 0").select("brand_id", "rate_date", "canonical").withColumn("seq", F.lit(1)), "rates")
    snap = lambda t: t.groupBy("rate_date").agg(S.rounded(F.median("canonical"), 4).alias("median_24k"), F.count("*").alias("n"))
    store, snaps, at = Store(_at(spark, "merged"), by_month("rate_date")), Store(_at(spark, "snapshots"), by_month("rate_date")), _at(spark, "checkpoint")
    store.begin(r.filter("brand_id % 3 = 0"))
    snaps.begin(snap(store.read(spark)))
    step = snapshot_step(store, lambda a, b: sinks.merge_rates(a, b, seq="seq"), snaps, "rate_date", snap, at)
    jobs.for_each_batch(_files(spark, r.filter("brand_id % 3 <> 0"), "quotes", parts=8), at, step).awaitTermination()
    return snaps.read(spark)


@query(f"WITH {B.SUBS}, {B.PAYLOADS}, {LAST} SELECT coalesce(s.key, l.key) AS key, coalesce(l.name, s.name) AS name, coalesce(l.city, s.city) AS city FROM subs s FULL JOIN l ON s.key = l.key")
def stream_subscribers(spark, sf):
    """Payloads upserted into the stored subscribers batch by batch, in order of their numbers; a batch rewrites the shares of the keys it touches."""
    store, src, at = Store(_at(spark, "subscribers"), by_hash("key", parts=16)), _at(spark, "payloads"), _at(spark, "checkpoint")
    store.begin(B.subscribers(spark, sf).select("key", "name", "city", "updated_at"))
    p = B.payloads(spark, sf).select("seq", "email", "name", "city")
    bounds = p.agg(F.percentile_approx("seq", [0.3, 0.6])).first()[0]
    place = F.when(F.col("seq") <= bounds[0], 0).when(F.col("seq") <= bounds[1], 1).otherwise(2)
    for k in range(3):  # files in the order of their rows
        p.filter(place == k).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(src)
    merge = lambda old, new: subscribers.merge_subscribers(old, new, ["name", "city"], _day("2024-02-01"))
    key = F.pmod(F.xxhash64(S.email_key(F.col("email"))), F.lit(16)).cast("string")
    jobs.for_each_batch(stream, at, store.step(merge, at, part=key)).awaitTermination()
    return store.read(spark).select("key", "name", "city")


# ---- visitors and states
@query(f"{V}, v AS (SELECT * FROM views WHERE session_id IS NOT NULL) SELECT day, count(DISTINCT session_id) AS visitors FROM v WHERE day < (SELECT max(day) FROM v) - 2 GROUP BY 1")
def stream_daily_visitors(spark, sf):
    """Views arrive up to forty hours after later ones; the days that the watermark has closed."""
    out, at, src = _at(spark, "visitors"), _at(spark, "checkpoint"), _at(spark, "views")
    v = B.views(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "session_id", (F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("id") % 5 * 36_000).alias("arrives"))
    v.repartitionByRange(4, "arrives").write.parquet(f"{src}-all")
    order = spark.read.parquet(f"{src}-all")
    bounds = order.agg(F.percentile_approx("arrives", [0.25, 0.5, 0.75])).first()[0]
    for k, (a, b) in enumerate(zip([None, *bounds], [*bounds, None], strict=True)):  # files in the order of arrival
        own = order.filter((F.lit(a is None) | (F.col("arrives") > F.lit(a))) & (F.lit(b is None) | (F.col("arrives") <= F.lit(b))))
        own.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(order.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.to_table(jobs.daily_visitors(stream), out, at)
    last = B.views(spark, sf).agg(F.max("day").alias("last"))  # one row
    return spark.read.parquet(out).crossJoin(F.broadcast(last)).filter("day < date_sub(last, 2)").select("day", "visitors")


@contextmanager
def _rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, jobs.ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


DAY_MS = 86_400_000
CLOSED = f"(SELECT (max(epoch_ms(ts)) - {DAY_MS}) // {DAY_MS} * {DAY_MS} FROM events WHERE event_type = 'click')"


@query(SQL["click_debounce"].replace("SELECT session_id, id FROM w WHERE kept", f"SELECT w.session_id, w.id FROM w JOIN clicks USING (id) WHERE kept AND clicks.ms < {CLOSED}"))
def stream_debounce(spark, sf):
    """Buckets of a day, and a watermark of a day: the clicks of the days that it has closed."""
    out, at = _at(spark, "debounce"), _at(spark, "checkpoint")
    with _rocks(spark):
        c = B.clicks(spark, sf).select("session_id", "label", "ms", "id", F.col("ts").cast("timestamp").alias("ts"))
        jobs.to_table(jobs.debounce(_files(spark, c, "clicks", 1, parts=8), DAY_MS, "1 day", DAY_MS), out, at)
    return spark.read.parquet(out)


@query("""SELECT p_brand AS brand, arg_max(p_type, p_partkey) FILTER (p_partkey % 17 = 0) AS strategy, count(*) FILTER (p_partkey % 17 = 0)::BIGINT AS hits, count(*) FILTER (p_partkey % 17 <> 0)::BIGINT AS misses,
1000 * (max(p_partkey) + 86400) AS seen FROM part GROUP BY 1""")
def stream_profiles(spark, sf):
    out, at = _at(spark, "profiles"), _at(spark, "checkpoint")
    with _rocks(spark):
        p = B.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 17 == 0, F.col("p_type")).alias("strategy"), F.timestamp_seconds(F.col("p_partkey") + 86_400).alias("ts"))
        q = jobs.learn_profiles(_files(spark, p, "results", 2)).writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True)
        q.foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/v{n}")).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/v*")
    return rows.groupBy("brand").agg(F.max_by(F.struct("strategy", "hits", "misses", "seen"), F.struct("batch", F.col("hits") + F.col("misses"))).alias("r")).select("brand", "r.*")


@query(f"{V} SELECT day, page, count(*) AS views FROM views GROUP BY ALL")
def stream_log(spark, sf):
    """Views appended by a stream, a folder for each day, and read as a log."""
    at = _at(spark, "log")
    v = B.views(spark, sf).select("id", F.col("ts").alias("created_at"), "day", "page")
    sinks.append_events(_files(spark, v, "views", 2), at, _at(spark, "checkpoint")).awaitTermination()
    log = readers.read_log(spark, at)
    return log.groupBy("day", "page").agg(F.count("*").alias("views"))
