"""Streams: daily rollups, click debounce, profile learning, send guard; merges are in store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S

#: Local midnight (UTC + 5:30) in UTC.
MIDNIGHT = "18 hours 30 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def daily_views(views: DataFrame, late: str = "2 days") -> DataFrame:
    """ts.  Views per local day."""
    w = F.window("ts", "1 day", "1 day", MIDNIGHT)
    return views.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("views")).select(S.local_day(F.col("window.start")).alias("day"), "views")


def daily_visitors(views: DataFrame, late: str = "2 days") -> DataFrame:
    """ts, session_id.  Distinct sessions per local day: duplicates are dropped within the watermark, then counted by the day's window.  The watermark must
    wait a day or longer, since two views of a day may be that far apart."""
    length = views.sparkSession.sql(f"SELECT INTERVAL '0' SECOND + INTERVAL {late} >= INTERVAL '1' DAY").first()[0]
    if not length:
        raise ValueError("the watermark must wait a day or longer")
    v = views.filter(F.coalesce(F.col("session_id").cast("string"), F.lit("")) != "")
    v = v.withColumn("day", S.local_day(F.col("ts"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["day", "session_id"])
    w = F.window("ts", "1 day", "1 day", MIDNIGHT)
    return v.groupBy(w).agg(F.count("*").alias("visitors")).select(S.local_day(F.col("window.start")).alias("day"), "visitors")


class Debounce(StatefulProcessor):
    """Clicks of a session wait in buckets of width_ms until the watermark has passed a bucket's end; then the bucket is gone through in order, with the label and
    time of the session's last kept click as state.  That state ends gap_ms after the click, since no later one depends on it.

    Each use of state is a message to the JVM and back, so a session's new clicks are appended together, its timer is that of the first bucket alone, and a timer takes
    all buckets that the watermark has passed.  There is always a timer at the end of the first bucket that waits, or before."""

    MOST = 10_000  # rows of a session that are appended at once

    def __init__(self, gap_ms: int = 2000, width_ms: int = 60_000):
        self.gap, self.width = gap_ms, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "bucket long, ms array<long>, id array<long>, label array<string>")
        self.last = handle.getValueState("last", "label string, ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed, first = timerValues.getCurrentWatermarkInMs(), None
        while part := list(islice(rows, self.MOST)):
            new = {}
            for r in part:
                bucket = r["ms"] // self.width
                if (bucket + 1) * self.width > closed:  # else too late: its bucket has been gone through
                    for to, x in zip(new.setdefault(bucket, ([], [], [])), (r["ms"], r["id"], r["label"]), strict=True):
                        to.append(x)
            if new:
                self.waiting.appendList([(bucket, *own) for bucket, own in new.items()])
                first = min(new) if first is None else min(first, *new)
        if first is not None:
            self.handle.registerTimer((first + 1) * self.width)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs() // self.width  # buckets before this one
        due, later = {}, []
        for bucket, *own in self.waiting.get():
            if bucket < closed:
                due.setdefault(bucket, []).extend(zip(*own, strict=True))
            else:
                later.append((bucket, *own))
        had = self.last.get()
        label, ms = had or (None, None)
        for bucket in sorted(due):
            for at, i, own in sorted(due.pop(bucket), key=lambda x: x[:2]):
                if ms is not None and label is not None and label == own and at - ms < self.gap:
                    continue
                label, ms = own, at
                yield Row(session_id=key[0], id=i)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer((min(x[0] for x in later) + 1) * self.width)
        else:
            self.waiting.clear()
        if ms is not None and ms + self.gap > closed * self.width:
            self.last.update((label, ms))
            self.handle.registerTimer(-(-(ms + self.gap) // self.width) * self.width)
        elif had is not None:
            self.last.clear()

    def close(self) -> None:
        pass


def debounce(clicks: DataFrame, gap_ms: int = 2000, late: str = "1 hour", width_ms: int = 60_000) -> DataFrame:
    """session_id long, label, ms, id, ts.  session_id and id of the kept clicks, once the watermark has passed them; later ones are dropped.  Needs the RocksDB state store."""
    c = clicks.select("session_id", "label", "ms", "id", "ts").withWatermark("ts", late)
    return c.groupBy("session_id").transformWithState(Debounce(gap_ms, width_ms), "session_id long, id long", "append", "eventTime")


class Learn(StatefulProcessor):
    """A brand's latest strategy, its hits and misses.  Frames are folded one by one, in whatever order rows come.  A brand without results for keep_ms begins anew."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", "strategy string, found long, hits long, misses long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        strategy, found, hits, misses, seen = self.profile.get() if self.profile.exists() else (None, None, 0, 0, 0)
        if seen + self.keep <= timerValues.getCurrentWatermarkInMs():  # its timer is due after these rows
            strategy, found, hits, misses, seen = None, None, 0, 0, 0
        for frame in rows:
            good = frame[frame["strategy"].notna()]
            hits, misses = hits + len(good), misses + len(frame) - len(good)
            if len(good) and (found is None or good["ms"].max() >= found):
                best = good.loc[good["ms"].idxmax()]
                strategy, found = str(best["strategy"]), int(best["ms"])
            seen = max(seen, int(frame["ms"].max()))
        self.profile.update((strategy, found, int(hits), int(misses), seen))
        self.handle.registerTimer(seen + self.keep)
        yield pd.DataFrame({"brand": [key[0]], "strategy": [strategy], "hits": [hits], "misses": [misses], "seen": [seen]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.profile.exists() and self.profile.get()[4] + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
            self.profile.clear()
        return iter(())

    def close(self) -> None:
        pass


def learn_profiles(results: DataFrame, late: str = "1 day", keep_days: int = 90) -> DataFrame:
    """brand, strategy (null: a miss), ts.  The brand's profile after each batch that has results of it (more than once where they come in several parts: the one of the most
    results counts); seen: the time of the latest, in milliseconds."""
    r = results.select("brand", "strategy", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return r.groupBy("brand").transformWithStateInPandas(Learn(keep_days * 86_400_000), "brand string, strategy string, hits long, misses long, seen long", "update", "eventTime")


def once_a_day(sends: DataFrame, late: str = "2 days") -> DataFrame:
    """ts, id.  The first send of each subscriber and day."""
    return sends.withColumn("day", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "day"])


def for_each_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]):
    """Runs step over what is there, batch by batch, then stops: intraday merges, subscriber upserts, snapshots of touched days."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
