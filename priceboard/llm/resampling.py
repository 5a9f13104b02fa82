"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and pairs of words are hashed to BUCKETS buckets; the target model counts the buckets of texts
labelled good, the raw model those of all texts.  A document's log weight is the sum over its n-grams
of log(target share / raw share), the ratio of what the two models say of it.  With
Gumbel noise, keyed by the document and a seed, the k largest keys are a sample without replacement in
proportion to the weights.  With ``per_ngram`` the sum is divided by the number of n-grams and multiplied by it, so that length
alone decides nothing; the sample is then in proportion to that power of the ratio.

The raw counts cover all texts.  Target texts are the first MAX_TARGET labelled rows by hash (a documented
bound, so their ids can be broadcast); k is the share of good labels times the number of documents.
Counts of a task are one row per bucket; the k-th key is found exactly by narrowing histograms.

Defined cases: a null or empty text has weight 0 (neither model says anything); ties with the k-th
key are all selected; repeated rows have equal keys; null labels are left out, and an id labelled more than once is a
target if any of its labels is good; each row of a labelled id is a target text; a null id is none; without labels both
models are equal and noise decides; texts of any length are read whole; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, byte_blocks, mix, packed, stored, windows

BUCKETS = 10_000
MAX_TARGET = 20_000
BLOCK_BYTES = 2_000_000
BINS = 4096


def _buckets(texts: list[bytes], words: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the text) of every word and pair of words."""
    tokens, size = [], []
    for t in texts:
        found = t.lower().split()
        tokens += found
        size.append(len(found))
    h, doc = words.of(tokens), np.repeat(np.arange(len(texts)), size)
    two = windows(h, 2)
    within = doc[1:] == doc[:-1]
    h, doc = np.concatenate([mix(h), two[within] if len(two) else two]), np.concatenate([doc, doc[1:][within]])
    return (h % np.uint64(BUCKETS)).astype(np.int64), doc


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return packed(docs, __id=key, __text=text).select(F.col("__id").alias("id"), F.coalesce("__text", F.lit("")).cast("binary").alias("text"))


def models(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TARGET) -> np.ndarray:
    """log(target share / raw share) of each bucket, with one added to every count."""
    good = packed(labels, __id=key, __label=label).filter("__id is not null and __label = 1").select(F.col("__id").alias("id")).distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(most).withColumn("good", F.lit(True))
    rows = _rows(docs, key, text).join(F.broadcast(good), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def counted(batches):
        words, sums = WordHash(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            is_good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in byte_blocks(batch.column(0), BLOCK_BYTES):
                n, doc = _buckets(batch.column(0).slice(a, b - a).to_pylist(), words)
                sums[0] += np.bincount(n, minlength=BUCKETS)
                sums[1] += np.bincount(n[is_good[a:b][doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "target"])

    got = rows.mapInArrow(counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[0, got["bucket"]], counts[1, got["bucket"]] = got["raw"], got["target"]
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    share = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def weigh(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 0, per_ngram: float | None = None) -> DataFrame:
    """id, log_weight, key (log weight and noise)."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        words, r = WordHash(), held.value
        for batch in batches:
            for a, b in byte_blocks(batch.column(1), BLOCK_BYTES):
                n, doc = _buckets(batch.column(1).slice(a, b - a).to_pylist(), words)
                total = np.bincount(doc, r[n], b - a)
                if per_ngram is not None:
                    total *= per_ngram / np.maximum(np.bincount(doc, minlength=b - a), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(total)], ["id", "u", "log_weight"])

    # a number in (0, 1) from the row and the seed
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "text"), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    rows = _rows(docs, key, text).select("id", "text", u.alias("u"))
    out = rows.mapInArrow(run, f"id {kind}, u double, log_weight double")
    return out.select("id", "log_weight", (F.col("log_weight") - F.log(-F.log("u"))).alias("key"))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """Exactly, by histograms of BINS bins over ever smaller ranges."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = (hi - lo) / BINS
        if width == 0 or lo + width == lo:
            break
        n = F.least(F.floor((F.col(column) - lo) / width), F.lit(BINS - 1))
        bins = df.filter(F.col(column).between(lo, hi)).groupBy(n.alias("n")).agg(F.count("*").alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for row in sorted(bins.collect(), key=lambda r: -r["n"]):  # BINS rows at most
            if row["c"] >= k:
                lo, hi = row["lo"], row["hi"]
                break
            k -= row["c"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", share: float | None = None, seed: int = 0, per_ngram: float | None = None) -> DataFrame:
    """id, log_weight, key, selected."""
    out = stored(weigh(docs, models(docs, labels, key, text, label), key, text, seed, per_ngram), "weights")
    if share is None:
        share = packed(labels, __label=label).agg(F.avg((F.col("__label") == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    k = math.ceil(share * out.count())
    limit = kth_largest(out, "key", k) if k else math.inf
    return out.withColumn("selected", F.col("key") >= F.lit(limit))
