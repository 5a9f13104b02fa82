import datetime as dt
import random

import pytest

from priceboard.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, src, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def state(spark, at, name):
    df = spark.read.format("statestore").option("path", at).option("stateVarName", name).load()
    return df.collect()


def test_debounce_state_ends(spark, rocks, tmp_path):
    rng = random.Random(4)
    clicks = [(rng.randrange(5), rng.choice(["a", "b", None]), rng.randrange(60_000), i) for i in range(240)]
    clicks += [(7, "hot", 250 * i, 1000 + i) for i in range(200)]
    arrive = sorted(clicks, key=lambda c: c[2] + rng.randrange(9_000))  # up to nine seconds late, within the watermark
    row = lambda c: (*c, START + dt.timedelta(milliseconds=c[2]))
    epoch = int((START - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    batches = [[row(c) for c in arrive[k : k + 110]] for k in range(0, len(arrive), 110)]
    # two clicks of another session, an hour and two hours later, close all buckets; a click of long ago is dropped
    batches += [[row((9, "x", 3_600_000, 5000))], [row((9, "x", 7_200_000, 5001)), row((0, "late", 5, 5002))]]
    batches = [[(s, label, epoch + ms, i, ts) for s, label, ms, i, ts in b] for b in batches]
    stream = feed(spark, f"{tmp_path}/src", batches, "session_id long, label string, ms long, id long, ts timestamp")
    out, at = f"{tmp_path}/out", f"{tmp_path}/c"
    jobs.to_table(jobs.debounce(stream, 2000, "10 seconds", 1000), out, at)
    kept, last = [], {}
    for s, label, ms, i in sorted(clicks, key=lambda c: (c[2], c[3])):
        k = last.get(s)
        if k is None or label is None or k[0] != label or ms - k[1] >= 2000:
            kept.append((s, i))
            last[s] = (label, ms)
    got = sorted((r["session_id"], r["id"]) for r in spark.read.parquet(out).collect())
    assert got == sorted([*kept, (9, 5000)])
    assert [r["key"]["session_id"] for r in state(spark, at, "last")] in ([], [9])
    assert {r["key"]["session_id"] for r in state(spark, at, "waiting")} == {9}  # the one click that the watermark has not passed


def test_profiles_begin_anew(spark, rocks, tmp_path):
    day = lambda n: START + dt.timedelta(days=n)
    batches = [[("a", "s1", day(0)), ("a", None, day(1)), ("b", "s2", day(1)), ("a", "s0", day(-1))], [("b", None, day(8))], [("c", "s", day(30))], [("a", "s3", day(30)), ("b", "s4", day(30))]]
    stream = feed(spark, f"{tmp_path}/src", batches, "brand string, strategy string, ts timestamp")
    got = []
    step = lambda b, n: got.extend((n, r["brand"], r["strategy"], r["hits"], r["misses"]) for r in b.collect())
    jobs.learn_profiles(stream, "1 day", keep_days=10).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    per = {(b, s, h, m) for _, b, s, h, m in got}
    assert {("a", "s1", 2, 1), ("b", "s2", 1, 0), ("b", "s2", 1, 1), ("a", "s3", 1, 0), ("b", "s4", 1, 0)} <= per


def test_visitors_need_a_day_of_watermark(spark, tmp_path):
    rows = [(START, "s", 1)]
    stream = feed(spark, f"{tmp_path}/src", [rows], "ts timestamp, session_id string, id long")
    with pytest.raises(ValueError, match="a day or longer"):
        jobs.daily_visitors(stream, "2 hours")
    assert jobs.daily_visitors(stream, "36 hours").isStreaming


def test_visitors_with_late_events(spark, tmp_path):
    rng = random.Random(2)
    views = [(START + dt.timedelta(minutes=rng.randrange(12 * 1440)), rng.choice(["hot", "hot", "", None, *(f"s{i}" for i in range(12))])) for _ in range(900)]
    arrive = sorted(views, key=lambda v: v[0] + dt.timedelta(minutes=rng.randrange(1400)))
    stream = feed(spark, f"{tmp_path}/src", [arrive[k : k + 300] for k in range(0, 900, 300)], "ts timestamp, session_id string")
    jobs.to_table(jobs.daily_visitors(stream, "1 day"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = {r["day"]: r["visitors"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    local = lambda t: (t + dt.timedelta(minutes=330)).date()
    want = {}
    for t, s in views:
        if s:
            want.setdefault(local(t), set()).add(s)
    closed = max(t for t, _ in views) - dt.timedelta(days=2)
    assert len(got) >= 8 and all(len(want[d]) == n for d, n in got.items()) and all(d in got for d in want if d < local(closed))
