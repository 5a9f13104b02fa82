import datetime as dt

import pytest
from pyspark.sql import functions as F

from priceboard.sources import sinks
from priceboard.streaming import jobs
from priceboard.streaming.store import MissingVersion, Store, _paths, by_hash, snapshot_step

SCHEMA = "brand_id long, rate_date date, canonical double, seq long"
MERGE = staticmethod(lambda old, new: sinks.merge_rates(old, new, seq="seq")).__func__
DAY = lambda n: dt.date(2024, 1, n)


def frame(spark, rows):
    return spark.createDataFrame([(b, DAY(d), float(c), s) for b, d, c, s in rows], SCHEMA)


def rows_of(df):
    return sorted((r["brand_id"], r["rate_date"].day, r["canonical"], r["seq"]) for r in df.collect())


def by_day():
    return F.col("rate_date").cast("string")


def run(spark, src, at, step):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.for_each_batch(stream, at, step).awaitTermination()


BASE = [(1, 1, 100, 1), (2, 1, 200, 1), (1, 2, 110, 1), (9, 9, 900, 1)]


def test_begins_from_a_table_and_rewrites_what_it_touches(spark, tmp_path):
    store, src, at = Store(f"{tmp_path}/s", by_day()), f"{tmp_path}/src", f"{tmp_path}/c"
    store.begin(frame(spark, BASE))
    with pytest.raises(ValueError, match="has begun"):
        store.begin(frame(spark, BASE))
    frame(spark, [(1, 1, 101, 2), (3, 3, 300, 2), (2, 1, 1, 0)]).coalesce(1).write.parquet(src)
    run(spark, src, at, store.step(MERGE, at))
    want = [(1, 1, 101.0, 2), (1, 2, 110.0, 1), (2, 1, 200.0, 1), (3, 3, 300.0, 2), (9, 9, 900.0, 1)]
    assert rows_of(store.read(spark)) == want
    c = store.commit(spark)
    assert c.parts == {"p2024-01-01": 1, "p2024-01-03": 1, "p2024-01-02": 0, "p2024-01-09": 0} and list(c.batches.values()) == [0]
    # the same checkpoint goes on, a new one takes the table as it is
    frame(spark, [(1, 2, 111, 3)]).coalesce(1).write.mode("append").parquet(src)
    run(spark, src, at, store.step(MERGE, at))
    run(spark, src, f"{at}2", store.step(MERGE, f"{at}2"))
    assert rows_of(store.read(spark)) == sorted([(1, 2, 111.0, 3), *(w for w in want if w[:2] != (1, 2))])
    assert sorted(store.commit(spark).batches.values()) == [1, 1]
    assert rows_of(store.read(spark, ["p2024-01-09"])) == [(9, 9, 900.0, 1)]


@pytest.mark.parametrize("where", ["before the data", "between data and commit", "after the commit"])
def test_killed_writer(spark, tmp_path, monkeypatch, where):
    store, src, at = Store(f"{tmp_path}/s", by_day()), f"{tmp_path}/src", f"{tmp_path}/c"
    store.begin(frame(spark, BASE))
    frame(spark, [(1, 1, 101, 2), (3, 3, 300, 2)]).coalesce(1).write.parquet(src)
    name = "_write" if where == "before the data" else "_log"
    plain = getattr(Store, name)

    def killed(self, *args):
        if where == "after the commit":
            plain(self, *args)
        raise RuntimeError("killed")

    monkeypatch.setattr(Store, name, killed)
    with pytest.raises(Exception, match="killed"):
        run(spark, src, at, store.step(MERGE, at))
    monkeypatch.setattr(Store, name, plain)
    left = rows_of(store.read(spark))
    assert left == (sorted([(1, 1, 101.0, 2), (3, 3, 300.0, 2), *((b, d, float(c), s) for b, d, c, s in BASE[1:])]) if where == "after the commit" else sorted((b, d, float(c), s) for b, d, c, s in BASE))
    run(spark, src, at, store.step(MERGE, at))  # the batch runs again
    assert rows_of(store.read(spark)) == sorted([(1, 1, 101.0, 2), (3, 3, 300.0, 2), *((b, d, float(c), s) for b, d, c, s in BASE[1:])])
    assert store.commit(spark).version == 1


def test_missing_versions_and_batches_raise(spark, tmp_path):
    at = f"{tmp_path}/c"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metadata").write_text('{"id":"one"}')
    store = Store(f"{tmp_path}/s", by_day())
    new = frame(spark, [(1, 1, 7, 9)])
    with pytest.raises(MissingVersion, match="has not begun"):
        store.step(MERGE, at)(new, 0)
    store.begin(frame(spark, BASE))
    step = store.step(MERGE, at)
    with pytest.raises(MissingVersion, match="batch 1"):
        step(new, 1)
    for n in range(3):
        step(frame(spark, [(1, 1, 7 + n, 9 + n)]), n)
    before = rows_of(store.read(spark))
    step(frame(spark, [(1, 1, 0, 99)]), 1)  # a batch of long ago changes nothing
    assert rows_of(store.read(spark)) == before and (1, 1, 9.0, 11) in before
    import shutil

    shutil.move(f"{tmp_path}/s/log/v2", f"{tmp_path}/gone")
    with pytest.raises(MissingVersion, match=r"\[2\]"):
        store.read(spark)
    with pytest.raises(MissingVersion):
        step(new, 3)
    shutil.move(f"{tmp_path}/gone", f"{tmp_path}/s/log/v2")
    shutil.move(f"{tmp_path}/s/data/v0", f"{tmp_path}/gone")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read(spark).collect()


def test_rows_may_not_leave_their_partitions(spark, tmp_path):
    (tmp_path / "metadata").write_text('{"id":"one"}')
    store = Store(f"{tmp_path}/s", by_hash("brand_id", parts=8))
    store.begin(frame(spark, BASE))
    with pytest.raises(ValueError, match="does not touch"):
        store.step(lambda old, new: new.withColumn("brand_id", F.col("brand_id") + 1).unionByName(new.withColumn("brand_id", F.col("brand_id") + 2)), str(tmp_path))(frame(spark, [(1, 1, 1, 1)]), 0)
    store.step(lambda old, new: old.limit(0), str(tmp_path))(frame(spark, [(1, 1, 1, 1)]), 0)  # a partition may become empty
    assert {r[0] for r in rows_of(store.read(spark))} == {2, 9}
    assert _paths(spark, f"{tmp_path}/none") == []


def test_snapshots_of_touched_days(spark, tmp_path, monkeypatch):
    store, snaps, src, at = Store(f"{tmp_path}/s", by_day()), Store(f"{tmp_path}/o", by_day()), f"{tmp_path}/src", f"{tmp_path}/c"
    snap = lambda t: t.groupBy("rate_date").agg(F.median("canonical").alias("m"), F.count("*").alias("n"))
    store.begin(frame(spark, BASE))
    snaps.begin(snap(store.read(spark)))
    frame(spark, [(3, 1, 300, 2), (3, 5, 300, 2)]).coalesce(1).write.parquet(src)
    step = snapshot_step(store, MERGE, snaps, "rate_date", snap, at)
    plain = Store._log
    monkeypatch.setattr(Store, "_log", lambda self, *a: plain(self, *a) if self is store else 1 / 0)
    with pytest.raises(Exception, match="division"):
        run(spark, src, at, step)
    monkeypatch.setattr(Store, "_log", plain)
    run(spark, src, at, step)
    assert sorted((r["rate_date"].day, r["m"], r["n"]) for r in snaps.read(spark).collect()) == [(1, 200.0, 3), (2, 110.0, 1), (5, 300.0, 1), (9, 900.0, 1)]
    assert store.commit(spark).version == 1 and snaps.commit(spark).version == 1
