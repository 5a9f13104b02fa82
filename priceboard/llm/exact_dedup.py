"""Exact duplicates by an extendible-hash index on shared files.

A text's key is its 64-bit hash.  The directory points from the leading bits of a key to a bucket; a bucket of more than
capacity bytes is split in two by its next bit, and where it already has as many bits as the directory, the directory doubles.  Split
points are found from sums by prefix, STEP bits further each time, so texts are not moved while buckets split.  A bucket that more bits
cannot split (one hot key, or MAX_DEPTH bits) gets overflow pages.

Owner tasks take contiguous ranges of the directory, about capacity bytes each, sort them by key and go through the chain of every key: a
text is compared byte by byte with the distinct texts that the chain has so far, and joins one of them or lengthens the chain.  Pages of a
bucket have owners of their own, whose entries (one for each distinct text) meet in the next round, FAN_IN pages in one.  Only texts whose
key occurs more than once are moved: others are left out by a bitmap of 2**BITMAP bits, whose false hits make chains of one.

Keys, directory and entries are tables in spark.checkpoint.dir: the index.  A row finds its entry by key and SHA-256; two different texts
of one chain with the same SHA-256 would raise an error.

Defined cases: a null text counts as the empty one; texts are equal when all their bytes are, whatever their length; of equal texts the row of the
largest id stays (a null id is the least), and of rows that are equal in both exactly one; a text that occurs once is a group of one; an empty
table gives an empty result; other columns are not read, and may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, stored

#: Bytes of text in a bucket, and the least where the cluster has more cores than the texts fill.
CAPACITY, LEAST_CAPACITY = 64 << 20, 1 << 16
#: The directory has at most 2**MAX_DEPTH pointers; it is counted STEP bits at a time.  Buckets are made larger where there would be more than MAX_BUCKETS.
MAX_DEPTH, STEP, MAX_BUCKETS = 20, 4, 1 << 17
BITMAP = 24
FAN_IN = 64


@dataclass(frozen=True)
class Bucket:
    """The keys whose first depth bits are prefix; size in bytes; pages above one where it is too large and cannot be split."""

    prefix: int
    depth: int
    size: int
    pages: int = 1


@dataclass(frozen=True)
class Index:
    keys: DataFrame  # id, h, sha, size: a row for each document
    entries: DataFrame  # h, sha, top (largest id), n_top, n: a row for each distinct text whose key occurs more than once
    directory: DataFrame  # prefix, bucket, pages, owner: a row for each pointer
    depth: int
    hits: DataFrame  # the bitmap


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def _key(text: Column, bits: int) -> Column:
    """The leading bits of the hash; fewer than 64 are for tests of collisions."""
    return F.xxhash64(text).bitwiseAND(F.lit(-1 << (64 - bits) if bits else 0))


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def split_buckets(sizes: dict[int, tuple[int, int]], depth: int, upto: int, capacity: int, start: list[int]) -> tuple[list[Bucket], list[int]]:
    """The buckets of start (prefixes of depth bits) split while they are overfull, up to upto bits.  sizes: bytes and number of keys by prefix of upto
    bits.  Returns finished buckets, and prefixes of upto bits that are still overfull."""
    done, still = [], []
    inside: dict[int, list[int]] = {}
    for p in sorted(sizes):
        inside.setdefault(p >> (upto - depth), []).append(p)
    todo = [(p, depth, inside.get(p, [])) for p in start]
    while todo:
        p, d, own = todo.pop()
        size, n = sum(sizes[q][0] for q in own), sum(sizes[q][1] for q in own)
        if not n:
            continue
        if size <= capacity or n == 1:
            done.append(Bucket(p, d, size, -(-size // capacity) if size > capacity else 1))
        elif d == upto:
            still.append(p)
        else:
            half = 1 << (upto - d - 1)
            bound = (p << (upto - d)) + half
            todo += [(2 * p, d + 1, [q for q in own if q < bound]), (2 * p + 1, d + 1, [q for q in own if q >= bound])]
    return done, still


def grow(chains: DataFrame, capacity: int, max_depth: int = MAX_DEPTH) -> tuple[list[Bucket], int]:
    """chains: h, size.  The buckets in order of keys, and the bits of the directory.  What comes to the driver are sums by prefix of overfull
    buckets, which are fewer than MAX_BUCKETS."""
    depth, todo, done = 0, [0], []
    while todo:
        upto = min(depth + STEP, max_depth)
        rows = chains
        if depth:
            at = chains.sparkSession.createDataFrame([(p,) for p in todo], "p long")
            rows = rows.withColumn("p", _prefix(F.col("h"), depth)).join(F.broadcast(at), "p", "left_semi")
        counted = rows.groupBy(_prefix(F.col("h"), upto).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        sizes = {r["p"]: (r["size"], r["n"]) for r in counted.collect()}
        more, todo = split_buckets(sizes, depth, upto, capacity, todo)
        done, depth = done + more, upto
        if todo and depth == max_depth:
            done += [Bucket(p, depth, sizes[p][0], -(-sizes[p][0] // capacity)) for p in todo]
            break
    return sorted(done, key=lambda b: b.prefix << (64 - b.depth)), max((b.depth for b in done), default=0)


def pointers(buckets: list[Bucket], depth: int, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(prefix of depth bits, bucket, pages, first owner) for each pointer, and the number of owners.  Owners take neighbouring buckets up to capacity bytes."""
    out, owner, room = [], -1, 0
    for k, b in enumerate(buckets):
        if b.pages > 1 or b.size > room:
            owner, room = owner + 1, capacity
        room -= b.size
        first = b.prefix << (depth - b.depth)
        out += [(p, k, b.pages, owner) for p in range(first, first + (1 << (depth - b.depth)))]
        if b.pages > 1:
            owner, room = owner + b.pages - 1, 0
    return out, owner + 1


def _bitmap(chains: DataFrame) -> DataFrame:
    """w (the word's number), bits: at most 2**(BITMAP - 6) rows."""
    w, bit = _word(F.col("h"))
    return chains.groupBy(w.alias("w")).agg(F.bit_or(bit).alias("bits"))


def _word(h: Column) -> tuple[Column, Column]:
    at = F.xxhash64(h).bitwiseAND(F.lit((1 << BITMAP) - 1))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def _hit(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows with __hit: whether their key may occur more than once."""
    w, bit = _word(F.col("__h"))
    found = rows.withColumn("__w", w).join(F.broadcast(hits.withColumnRenamed("w", "__w").withColumnRenamed("bits", "__bits")), "__w", "left")
    return found.withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))).drop("__w", "__bits")


def _chained(texts: bool):
    """Owner of sorted rows: one entry for each distinct text of each chain."""

    def entries(chain):
        seen = set()
        for text, bucket, pages, top, n_top, n, h in chain:
            sha = hashlib.sha256(text).hexdigest()
            if sha in seen:
                raise ValueError("two texts of one chain have the same SHA-256")
            seen.add(sha)
            yield h, bucket, pages, sha, top, n_top, n, text if texts and pages > 1 else None

    def owner(batches):
        chain: list[list] = []
        for b in batches:
            out = []
            for h, bucket, pages, text, top, n_top, n in zip(*(b.column(c).to_pylist() for c in ("h", "bucket", "pages", "text", "top", "n_top", "n")), strict=True):
                if chain and chain[0][6] != h:
                    out += entries(chain)
                    chain = []
                for e in chain:
                    if e[0] == text:
                        e[5] += n
                        if e[3] == top:
                            e[4] += n_top
                        elif e[3] is None or (top is not None and top > e[3]):
                            e[3], e[4] = top, n_top
                        break
                else:
                    chain.append([text, bucket, pages, top, n_top, n, h])
            yield from _batch(out, b.schema)
            kind = b.schema
        if chain:
            yield from _batch(list(entries(chain)), kind)

    def _batch(rows, schema):
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), schema.field("top").type, pa.int64(), pa.int64(), pa.binary()]
            names = ["h", "bucket", "pages", "sha", "top", "n_top", "n", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return owner


def _compared(rows: DataFrame, texts: bool) -> DataFrame:
    """rows: h, bucket, pages, text, top, n_top, n, dealt to owners and sorted by h."""
    kind = rows.schema["top"].dataType.simpleString()
    columns = ["h", "bucket", "pages", "text", "top", "n_top", "n"]
    return rows.select(columns).mapInArrow(_chained(texts), f"h long, bucket int, pages int, sha string, top {kind}, n_top long, n long, text binary")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 64, max_depth: int = MAX_DEPTH) -> Index:
    spark = docs.sparkSession
    rows = packed(docs, __id=key, __text=text).select("__id", _text(F.col("__text")).alias("__text")).withColumn("__h", _key(F.col("__text"), bits))
    keys = stored(rows.select(F.col("__id").alias("id"), F.col("__h").alias("h"), F.sha2("__text", 256).alias("sha"), F.octet_length("__text").cast("long").alias("size")), "keys")
    chains = keys.groupBy("h").agg(F.sum(F.col("size") + 64).alias("size"), F.count("*").alias("n")).filter("n > 1")
    chains = stored(chains, "chains")
    total = chains.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cores = 4 * max(2, spark.sparkContext.defaultParallelism)
    capacity = max(min(capacity, max(LEAST_CAPACITY, -(-total // cores))), -(-2 * total // MAX_BUCKETS))
    buckets, depth = grow(chains, capacity, max_depth)
    table, owners = pointers(buckets, depth, capacity)
    directory = stored(_table(spark, table), "directory")
    hits = stored(_bitmap(chains), "bitmap")

    moved = _hit(rows, hits).filter("__hit").withColumn("prefix", _prefix(F.col("__h"), depth)).join(F.broadcast(directory), "prefix")
    page = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("pages")).cast("int")
    moved = moved.select(
        F.col("__h").alias("h"), "bucket", "pages", F.col("__text").alias("text"), F.col("__id").alias("top"), F.lit(1).cast("long").alias("n_top"), F.lit(1).cast("long").alias("n"),
        (F.col("owner") + F.when(F.col("pages") > 1, page).otherwise(0)).alias("owner"),
    )
    most = max((b.pages for b in buckets), default=1)
    found = stored(_compared(moved.repartitionById(max(1, owners), "owner").sortWithinPartitions("h"), most > 1), "entries")
    entries = found.filter("pages = 1")
    while most > 1:
        most = -(-most // FAN_IN)
        pages = F.ceil(F.col("pages") / FAN_IN).cast("int")
        rest = found.filter("pages > 1").withColumn("pages", pages).withColumn("page", F.pmod(F.xxhash64("top", "sha"), "pages"))
        rest = rest.repartition(max(1, min(owners, 4096)), "bucket", "page").sortWithinPartitions("h")
        found = stored(_compared(rest, most > 1), "entries")
        entries = entries.unionByName(found.filter("pages = 1"))
    return Index(keys, stored(entries.select("h", "sha", "top", "n_top", "n"), "entries"), directory, depth, hits)


def _table(spark: SparkSession, rows: list[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "prefix long, bucket int, pages int, owner int")


def groups(index: Index) -> DataFrame:
    """id, keep_id, group_size, kept, sha: a row for each document."""
    e = index.entries
    rows = index.keys.join(e, ["h", "sha"], "left")
    alone = F.col("n").isNull()
    top = F.coalesce(F.col("id").eqNullSafe(F.col("top")), F.lit(False))
    rows = rows.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("top")).alias("keep_id"), F.when(alone, 1).otherwise(F.col("n")).cast("long").alias("group_size"),
        (alone | top).alias("kept"), "sha", "h", F.coalesce("n_top", F.lit(1)).alias("n_top"),
    )
    if e.filter("n_top > 1").isEmpty():
        return rows.drop("h", "n_top")
    # rows that are equal in id and text: the first of them stays
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "ties")
    first = rows.filter("kept AND n_top > 1").groupBy("h", "sha").agg(F.min("place").alias("first"))
    rows = rows.join(first, ["h", "sha"], "left")
    return rows.select("id", "keep_id", "group_size", (F.col("kept") & F.coalesce(F.col("place") == F.col("first"), F.lit(True))).alias("kept"), "sha")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", index: Index | None = None, bits: int = 64) -> DataFrame:
    """The rows of docs that stay, all columns.  Texts whose key occurs once go by no shuffle.  Of rows equal in id and text the one of the least hash of all its columns stays."""
    index = index or build(docs, key, text, bits=bits)
    rows = packed(docs, __id=key, __text=text).withColumn("__text", _text(F.col("__text"))).withColumn("__h", _key(F.col("__text"), bits))
    rows = _hit(rows, index.hits)
    near = rows.filter("__hit").withColumn("__sha", F.sha2("__text", 256)).drop("__text")
    e = index.entries.select(F.col("h").alias("__h"), F.col("sha").alias("__sha"), F.col("top").alias("__top"), F.col("n_top").alias("__n"))
    near = near.join(e, ["__h", "__sha"], "left").filter(F.col("__n").isNull() | F.col("__id").eqNullSafe(F.col("__top")))
    tied = near.filter("__n > 1").withColumn("__r", F.row_number().over(Window.partitionBy("__h", "__sha").orderBy(F.xxhash64("__row")))).filter("__r = 1")
    kept = rows.filter("NOT __hit").select("__row").unionByName(near.filter("__n IS NULL OR __n = 1").select("__row")).unionByName(tied.select("__row"))
    return kept.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))


#: The same for DuckDB.
SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
