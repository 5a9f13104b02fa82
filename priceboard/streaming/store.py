"""A table that a stream merges into, partition by partition.

    path/data/v<version>/__part=<p>/   the partitions that a version wrote
    path/log/v<version>/               its commit: for each partition the version that holds it now, and the last batch of each stream

A version reads and rewrites the partitions that its batch touches and no others.  Its data are written first; the commit is one file, which is
there whole or not at all, so a writer that is killed before it leaves the version before as it was, and the batch that runs again
writes the same version anew.  A stream is known by the id in its checkpoint: a batch that is committed already changes nothing, a batch
that is not the next one raises, and a new checkpoint goes on with the table as it is.  Partitions are days, months or hashes of the key;
their number is bounded by MOST_PARTS.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST_PARTS = 20_000
PART = "__part"


class MissingVersion(ValueError):
    """The log or the checkpoint tells of a version or batch that is not there."""


@dataclass(frozen=True)
class Commit:
    version: int
    schema: StructType
    parts: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def by_hash(*keys: str, parts: int = 64) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")


def by_month(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def _named(part: Column) -> Column:
    """A name that no reader takes for a number or a date."""
    return F.concat(F.lit("p"), F.coalesce(part.cast("string"), F.lit("null")))


def _paths(spark: SparkSession, path: str) -> list[str]:
    """Files below path; none where it does not exist.  Only names are read."""
    try:
        return [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


class Store:
    def __init__(self, path: str, part: Column):
        """part: the partition of a row of the table."""
        self.path, self.part = path.rstrip("/"), part

    # ---- the log
    def commit(self, spark: SparkSession) -> Commit | None:
        """The last commit; None where the store has not begun."""
        versions = sorted({int(p.rsplit("/", 2)[-2][1:]) for p in _paths(spark, f"{self.path}/log") if p.endswith(".json")})
        if not versions:
            return None
        if versions != list(range(versions[-1] + 1)):
            raise MissingVersion(f"{self.path}: versions up to {versions[-1]}, but not {sorted(set(range(versions[-1])) - set(versions))}")
        rows = spark.read.schema("kind string, name string, value long").json(f"{self.path}/log/v{versions[-1]}").collect()
        of = lambda kind: {r["name"]: r["value"] for r in rows if r["kind"] == kind}
        (schema,) = of("schema")
        return Commit(versions[-1], StructType.fromJson(json.loads(schema)), of("part"), of("batch"))

    def _log(self, spark: SparkSession, c: Commit) -> None:
        rows = [("schema", c.schema.json(), 0), *(("part", k, v) for k, v in c.parts.items()), *(("batch", k, v) for k, v in c.batches.items())]
        spark.createDataFrame(rows, "kind string, name string, value long").coalesce(1).write.mode("overwrite").json(f"{self.path}/log/v{c.version}")

    # ---- data
    def _load(self, spark: SparkSession, c: Commit, parts: list[str] | None = None) -> DataFrame:
        at = [f"{self.path}/data/v{v}/{PART}={p}" for p, v in sorted(c.parts.items()) if parts is None or p in set(parts)]
        if not at:
            return spark.createDataFrame([], c.schema)
        return spark.read.schema(c.schema).parquet(*at)

    def _write(self, rows: DataFrame, version: int) -> list[str]:
        """Writes rows by partition; returns the partitions that have any."""
        spark, at = rows.sparkSession, f"{self.path}/data/v{version}"
        rows.withColumn(PART, _named(self.part)).hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(at)
        got = {p.split(f"/{PART}=", 1)[1].split("/", 1)[0] for p in _paths(spark, at) if f"/{PART}=" in p}
        if len(got) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} partitions")
        return sorted(got)

    # ---- what callers use
    def begin(self, table: DataFrame) -> None:
        """Version 0 from a table that is there already."""
        if self.commit(table.sparkSession) is not None:
            raise ValueError(f"{self.path} has begun")
        parts = self._write(table, 0)
        self._log(table.sparkSession, Commit(0, table.schema, {p: 0 for p in parts}))

    def read(self, spark: SparkSession, parts: list[str] | None = None) -> DataFrame:
        c = self.commit(spark)
        if c is None:
            raise MissingVersion(f"{self.path} has not begun")
        return self._load(spark, c, parts)

    def step(self, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, part: Column | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch.  merge(old, batch): the new rows of the partitions that the batch touches, from their old rows.  part: the partition of a
        row of the batch, where it is said otherwise there than in the table."""

        def run(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            c = self.commit(spark)
            if c is None:
                raise MissingVersion(f"{self.path} has not begun")
            stream = stream_id(spark, checkpoint)
            done = c.batches.get(stream, -1)
            if number <= done:
                return
            if number > done + 1:
                raise MissingVersion(f"{self.path}: batch {number} of a stream whose last one here is {done}")
            batch.persist()
            try:
                touched = [r[0] for r in batch.select(_named(self.part if part is None else part)).distinct().limit(MOST_PARTS + 1).collect()]
                if len(touched) > MOST_PARTS:
                    raise ValueError(f"a batch touches more than {MOST_PARTS} partitions")
                new = merge(self._load(spark, c, touched), batch)
                new = new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in c.schema))
                version = c.version + 1
                written = self._write(new, version)
                if not set(written) <= set(touched):
                    raise ValueError(f"the merge moved rows to partitions that the batch does not touch: {sorted(set(written) - set(touched))[:5]}")
                parts = {p: v for p, v in c.parts.items() if p not in set(touched)} | {p: version for p in written}
                self._log(spark, Commit(version, c.schema, parts, c.batches | {stream: number}))
            finally:
                batch.unpersist()

        return run


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a stream's checkpoint."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def snapshot_step(store: Store, merge: Callable[[DataFrame, DataFrame], DataFrame], snaps: Store, day: str, snapshot: Callable[[DataFrame], DataFrame], checkpoint: str) -> Callable[[DataFrame, int], None]:
    """The batch merged into store; then the snapshots of the days it touches, from the merged rows of their partitions, into snaps: other days are kept.
    Each of the two commits by itself, so a batch that failed between them does only what is left."""
    merged = store.step(merge, checkpoint)

    def step(batch: DataFrame, number: int) -> None:
        merged(batch, number)
        spark = batch.sparkSession

        def redo(old: DataFrame, batch: DataFrame) -> DataFrame:
            days = batch.select(day).distinct()
            parts = [r[0] for r in batch.select(_named(store.part)).distinct().collect()]
            return old.join(days, day, "left_anti").unionByName(snapshot(store.read(spark, parts).join(days, day, "left_semi")))

        snaps.step(redo, checkpoint)(batch, number)

    return step
