"""Mix sources to target weights by index arithmetic over fixed-length blocks of words.

The words of a source, its documents one after another, are packed into blocks of BLOCK words (the
last may be shorter).  A source's target gives the words the mix takes of it: whole passes over its
blocks, then a last pass that stops at the word where the target is met.  Each visit of a block is a
slot of the source.  For every output shard the number of slots of each source is drawn from a
multinomial distribution with the sources' shares; what the draws have beyond a source's slots, summed over
shards, is handed to the sources that got too few, so the mix meets every target.  The k-th slot of a
source is visit k of a pseudorandom permutation of its block numbers (a different one in each pass),
and slots meet the pieces of documents by joining on (source, block).

Nothing depends on a source's size being small: offsets are prefix sums in two levels (buckets of
documents by hash, then within a bucket), so a source with a third of all rows is spread over all
tasks, and the join key includes the block.  Per-source tables have one row per source.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its
own, last in order; a source without words has target 0; an empty table gives an empty mix; repeated
rows are rows of their own, and so are equal ids and texts of different sources; columns of other names, whatever
they are called, pass through; a text of any length is cut into blocks; reruns agree, whatever the
partitioning, since order and draws come from hashes of the rows and a seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, packed, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the input; a source gives MOST times its words at most.
SHARE, MOST = 1.5, 2
BLOCK = 128
#: Slots of an output shard: 2**17 blocks of 128 words, about 100 MB of text.
SHARD_SLOTS = 131_072
#: Buckets of documents in the prefix sums: bounds a task's share of one source at 1 / BUCKETS of its rows.
BUCKETS = 4096
#: Sources are names that people weigh by hand; their shares go to the tasks that draw.  More than this many is an error.
MAX_SOURCES = 100_000
#: Tasks that make slots, at most; each makes its slots shard by shard.
MAKERS = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: __source, __total.  Adds __target: ``share`` of all words dealt by weight, a source stopping at
    ``most`` times its words and its excess dealt again by weight until none is above.

    That end point is found at once: order sources by the level (limit / weight) at which each stops; those
    below the common level get their limit, the others weight times level.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("__weight", w).withColumn("__limit", F.lit(float(most)) * F.col("__total"))
    by_level = Window.orderBy(F.col("__limit") / F.col("__weight"), F.col("__source").asc_nulls_last())
    before, everyone = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("__full", F.coalesce(F.sum("__limit").over(before), F.lit(0.0)))
    t = t.withColumn("__left", F.sum("__weight").over(everyone) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
    t = t.withColumn("__want", F.lit(float(share)) * F.sum("__total").over(everyone))
    # the level if this source is the first that does not stop
    t = t.withColumn("__level", (F.col("__want") - F.col("__full")) / F.col("__left"))
    t = t.withColumn("__open", F.col("__level") * F.col("__weight") <= F.col("__limit"))
    level = F.first(F.when(F.col("__open"), F.col("__level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("__limit"), F.coalesce(level * F.col("__weight"), F.col("__limit")))
    return t.withColumn("__target", target).select("__source", "__total", "__target")


def _network(n: int, seed: int) -> tuple[np.uint64, np.uint64, np.ndarray]:
    """Half the bits of a four-round Feistel network over 0..n-1, their mask, and the keys of its rounds."""
    bits = max(1, (max(1, int(n) - 1).bit_length() + 1) // 2)
    return np.uint64(bits), np.uint64((1 << bits) - 1), np.random.default_rng(seed).integers(1 << 62, size=4, dtype=np.uint64)


def _round(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    f = (half + key) * np.uint64(0x9E3779B97F4A7C15)
    f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (f >> np.uint64(32)) & mask


def permutation(j: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Position j of a pseudorandom permutation of 0..n-1 (or where its value j is): a Feistel network on the next even
    number of bits, walking on while the result is n or more."""
    bits, mask, keys = _network(n, seed)

    def rounds(x):
        left, right = x >> bits, x & mask
        for k in keys[::-1] if inverse else keys:
            left, right = (right ^ _round(left, k, mask), left) if inverse else (right, left ^ _round(right, k, mask))
        return (left << bits) | right

    out = rounds(j.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = rounds(out[far])
    return out.astype(np.int64)


def _seed(seed: int, source: str | None, lap: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(f"{seed}/{lap}/{'' if source is None else '=' + source}".encode(), digest_size=8).digest(), "big")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows: __source, __id, __key (hash of the row), __size.  Adds __from, the words before the row in its source."""
    r = rows.withColumn("__bucket", F.pmod(F.col("__key"), F.lit(BUCKETS)))
    totals = r.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inner = Window.partitionBy("__source", "__bucket").orderBy("__key", F.col("__id"), "__size").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("__in", F.coalesce(F.sum("__size").over(inner), F.lit(0)))
    same = F.col("r.__source").eqNullSafe(F.col("t.__source")) & (F.col("r.__bucket") == F.col("t.__bucket"))
    return r.alias("r").join(totals.alias("t"), same).select("r.*", (F.col("__base") + F.col("__in")).alias("__from"))


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """sources: __source, __total, __target.  The slots of the mix: __shard, __source, __pass, __block, __take (words from the
    start of the block)."""
    spark = sources.sparkSession
    table = sources.filter("__target > 0").orderBy(F.col("__source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(table) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = []
    for row in table:
        size, want = int(row["__total"]), min(int(round(row["__target"])), MOST * int(row["__total"]))
        n, tail = -(-size // block), size - (-(-size // block) - 1) * block
        laps, rest = divmod(want, size)
        # slots of the last pass: whole blocks until rest is reached; the short block comes where the permutation has it
        last = 0
        if rest:
            last = min(n, -(-rest // block) + 1)
            while last > 1 and _words(last - 1, n, block, tail, _seed(seed, row["__source"], laps)) >= rest:
                last -= 1
        plan.append((row["__source"], size, n, tail, laps, rest, laps * n + last))
    need = np.array([p[-1] for p in plan], np.int64)
    total = int(need.sum())
    shards = -(-total // shard_slots)
    share = need / max(1, total)

    def drawn(ids):
        for batch in ids:
            for s in batch["id"]:
                size = min(shard_slots, total - int(s) * shard_slots)
                got = np.random.default_rng([seed, int(s)]).multinomial(size, share)
                k = np.flatnonzero(got)
                yield pd.DataFrame({"__shard": int(s), "__k": k, "__n": got[k]})

    counts = spark.range(shards).mapInPandas(drawn, "__shard long, __k long, __n long") if total else spark.createDataFrame([], "__shard long, __k long, __n long")
    counts = stored(counts, "draws")
    sums = {r["__k"]: r["n"] for r in counts.groupBy("__k").agg(F.sum("__n").alias("n")).collect()}  # a row per source
    got = np.array([sums.get(i, 0) for i in range(len(plan))], np.int64)
    over, under = np.maximum(got - need, 0), np.maximum(need - got, 0)
    over_at, under_ends = np.cumsum(over) - over, np.cumsum(under)
    before = Window.partitionBy("__k").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))

    def dealt(frames):
        for f in frames:
            for s, k, n, start in f[["__shard", "__k", "__n", "__start"]].itertuples(index=False):
                at = np.arange(start, start + n)
                who = np.full(n, k)
                extra = at >= need[k]
                if extra.any():  # surplus slot u goes to the source whose shortfall holds u
                    u = over_at[k] + at[extra] - need[k]
                    to = np.searchsorted(under_ends, u, side="right")
                    who[extra], at[extra] = to, got[to] + u - (under_ends[to] - under[to])
                for i in np.unique(who):
                    source, size, nb, tail, laps, rest, _ = plan[i]
                    mine = at[who == i]
                    lap, j = mine // nb, mine % nb
                    for e in np.unique(lap):
                        jj = j[lap == e]
                        key = _seed(seed, source, int(e))
                        b = permutation(jj, nb, key)
                        take = np.where(b == nb - 1, tail, block)
                        if e == laps:
                            done = jj * block - np.where(jj > _place(nb, key), block - tail, 0)
                            take = np.clip(rest - done, 0, take)
                        yield pd.DataFrame({"__shard": s, "__source": pd.Series([source] * len(b), dtype=object), "__pass": int(e), "__block": b, "__take": take})

    # a source's draws met in one task for their sums; its slots are made by shard
    ranges = ranges.repartition(max(1, min(4 * shards, MAKERS)), "__shard", "__k")
    return ranges.mapInPandas(dealt, "__shard long, __source string, __pass int, __block long, __take long").filter("__take > 0")


def _place(n: int, key: int) -> int:
    """Where the permutation has the last block."""
    return int(permutation(np.array([n - 1]), n, key, inverse=True)[0])


def _words(k: int, n: int, block: int, tail: int, key: int) -> int:
    """Words in the first k slots of a pass."""
    return k * block - (block - tail if k > _place(n, key) else 0)


def sized(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    rows = packed(docs, __text=text, __source=source, __id=key)
    rows = rows.withColumn("__source", F.col("__source").cast("string"))
    return rows.withColumns({"__size": n_words(F.col("__text")), "__key": F.xxhash64("__id", "__text")})


def mix(rows: DataFrame, seed: int = 0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """rows: __source, __id, __key, __size.  Gives the sources' targets, and the mix as spans of documents: __shard, __source, __pass,
    __block, __id, __key, __from (unique for each row of a source that has words), __first (word of the document), __words."""
    sources = stored(targets(rows.groupBy("__source").agg(F.sum("__size").alias("__total"))), "targets")
    placed = pieces(rows.filter("__size > 0").select("__source", "__id", "__key", "__size"), block)
    first, last = F.floor(F.col("__from") / block), F.floor((F.col("__from") + F.col("__size") - 1) / block)
    cut = placed.withColumn("__block", F.explode(F.sequence(first, last)))
    same = F.col("p.__source").eqNullSafe(F.col("s.__source")) & (F.col("p.__block") == F.col("s.__block"))
    # slots come from few short rows, so their number is underestimated: without the hint they would be broadcast
    joined = cut.alias("p").join(slots(sources, block, shard_slots, seed).hint("merge").alias("s"), same).select("p.*", "s.__shard", "s.__pass", "s.__take")
    start = F.greatest(F.col("__from"), F.col("__block") * block)
    end = F.least(F.col("__from") + F.col("__size"), F.col("__block") * block + F.col("__take"))
    spans = joined.withColumns({"__first": start - F.col("__from"), "__words": end - start}).filter("__words > 0")
    return sources, spans


def taken(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row of docs."""
    rows = stored(sized(docs, text, source, key).select("__source", "__id", "__key", "__size"), "sizes")
    sources, spans = mix(rows, **how)
    # numbers rows that are equal, so that each keeps its own spans
    got = spans.groupBy("__source", "__id", "__key", "__from").agg(F.sum("__words").alias("__taken"))
    got = got.withColumn("__nth", F.row_number().over(Window.partitionBy("__source", "__id", "__key").orderBy("__from")))
    all_rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__source", "__id", "__key").orderBy("__size")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("__source", "__id", "__key", "__nth")]
    cond = same[0] & same[1] & same[2] & same[3]
    out = all_rows.alias("r").join(got.alias("g"), cond, "left")
    out = out.join(sources.alias("t"), F.col("r.__source").eqNullSafe(F.col("t.__source")), "left")
    return out.select(
        F.col("r.__id").alias(key), F.col("r.__size").alias("size"), F.col("t.__total").alias("source_size"),
        F.col("t.__target").alias("target"), F.coalesce("g.__taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mix as rows like docs': one for each pass that takes words of a document, its text cut to the words taken
    (unchanged if all are).  An integer column n_chars, if docs has one, is brought up to date."""
    import re

    # rows of one source, id and text may differ in other columns; their order must be the same in each run
    full = sized(docs, text, source, key).withColumn("__tie", F.xxhash64(F.to_json("__row") if "map<" in docs.schema.simpleString() else "__row"))
    rows = stored(full.select("__source", "__id", "__key", "__size"), "sizes")
    _, spans = mix(rows, **how)
    cuts = spans.groupBy("__id", "__key", "__from", "__source", "__pass").agg(F.array_sort(F.collect_list(F.struct("__first", "__words"))).alias("__cuts"))
    # each row of a source, id and text gets the spans of one place
    nth = Window.partitionBy("__source", "__id", "__key").orderBy("__from")
    cuts = cuts.select("__source", "__id", "__key", "__pass", "__cuts", F.dense_rank().over(nth).alias("__nth"))
    numbered = full.withColumn("__nth", F.row_number().over(Window.partitionBy("__source", "__id", "__key").orderBy("__tie")))
    same = F.col("r.__source").eqNullSafe(F.col("c.__source")) & F.col("r.__id").eqNullSafe(F.col("c.__id")) & (F.col("r.__key") == F.col("c.__key")) & (F.col("r.__nth") == F.col("c.__nth"))
    joined = numbered.alias("r").join(cuts.alias("c"), same).select("r.__row", "r.__text", "r.__size", "c.__cuts")
    word = re.compile(r"[^\x20\x09-\x0D]+")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, sizes: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, size, parts in zip(texts, sizes, cuts, strict=True):
            runs: list[list[int]] = []
            for p in parts:
                if runs and runs[-1][1] == p["__first"]:
                    runs[-1][1] += p["__words"]
                else:
                    runs.append([p["__first"], p["__first"] + p["__words"]])
            if runs == [[0, size]]:
                out.append(t)
                continue
            at = [m.span() for m in word.finditer(t)]
            out.append("\n".join(t[at[a][0] : at[b - 1][1]] for a, b in runs))
        return pd.Series(out, dtype=object)

    done = joined.withColumn("__new", cut("__text", "__size", "__cuts"))
    cols = [F.col("__new").alias(c) if c == text else F.length("__new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*cols)
