"""Click debounce: a click is dropped when the last kept click of its session has the same label and is less than gap_ms older.

Clicks are sorted by (session, time, id) and dealt in that order to blocks of about BLOCK_ROWS clicks, so a session with a third of all clicks lies in
many blocks.  A click whose label differs from the click before, or that is gap_ms or more later, is kept whatever came before; a block is
therefore known from its first such click on, and only the clicks before it (one label, close together) wait for the block before.  Where a whole
block waits, what it hands on depends on which of its clicks is the first kept one: each that may be so links to the next kept click of a later
block (found in the block by pointer jumping), and these links are composed by doubling, so a chain of n such blocks takes log2(n) joins.  The
driver sees one row for each block.

A null label is like no other; sessions may be null; ids break ties of time.  Rows come in any order; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored

BLOCK_ROWS, MOST_BLOCKS = 250_000, 20_000


def _sort_key(batch, names):
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _folded(gap: int):
    """Sorted clicks of one block: kept is null for those that wait for the block before."""

    def run(batches):
        block, at, waiting, before, last = TaskContext.get().partitionId(), 0, True, None, None
        for b in batches:
            kept = []
            for session, label, ms in _sort_key(b, ("session_id", "label", "ms")):
                sure = before is not None and (session != before[0] or label is None or label != before[1] or ms - before[2] >= gap)
                if at == 0 and label is None:
                    sure = True  # kept after any click
                waiting = waiting and not sure
                if waiting:
                    kept.append(None)
                else:
                    kept.append(sure or ms - last >= gap)
                    last = ms if kept[-1] else last
                before = (session, label, ms)
                at += 1
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([block] * n, pa.int32()), pa.array(range(at - n, at), pa.int64()), pa.array(kept, pa.bool_())], [*b.schema.names, "block", "at", "kept"])

    return run


def entries(ms: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted times of a block that waits as a whole.  The times at which its first kept click may be (within gap of its first click, and the first one after),
    and for each the time of the last kept click of the block."""
    n = len(ms)
    to = np.append(np.searchsorted(ms, ms + gap, "left"), n)  # the next kept click after each; n is none
    last = np.arange(n + 1)
    while True:  # jump twice as far each time
        on = to[last]
        if (on[:n] == n).all():
            break
        last = np.where(on < n, on, last)
        step = to[to]
        to = np.where(step < n, step, to)
    first = np.unique(ms[: int(np.searchsorted(ms, ms[0] + gap, "left")) + 1])
    at = np.searchsorted(ms, first, "left")
    return first, ms[last[at]]


def _reached(spark, clicks: DataFrame, whole: list[dict], gap: int) -> dict[int, int]:
    """whole: blocks that wait as a whole, in order, each with block, head (the time of the kept click before it, or null), first, last, and chain
    (blocks of one session and label that follow each other).  The last kept time of each block that has a kept click."""
    ends = {}
    for w in whole:
        ends.setdefault(w["chain"], []).append((w["block"], w["last"]))
    chain = {w["block"]: w["chain"] for w in whole}
    ends = {c: (np.array([b for b, _ in e]), np.array([t for _, t in e])) for c, e in ends.items()}

    def later(c: int, t: np.ndarray, after: int) -> np.ndarray:
        """The first block of the chain after a block whose last click is at t or later; -1 where there is none."""
        blocks, last = ends[c]
        k = np.maximum(np.searchsorted(last, t, "left"), np.searchsorted(blocks, after, "right"))
        return np.where(k < len(blocks), blocks[np.minimum(k, len(blocks) - 1)], -1)

    def links(key, rows: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        first, last = entries(np.sort(rows["ms"].to_numpy(np.int64)), gap)
        return pd.DataFrame({"block": block, "first": first, "last": last, "to": later(chain[block], last + gap, block)})

    # roots: the first kept click of a chain, by what is kept before it
    roots = {}
    for w in whole:
        if w["root"]:
            roots[w["chain"]] = w["first"] if w["head"] is None else w["head"] + gap
    starts = [(int(b), int(t)) for c, t in roots.items() if (b := later(c, np.array([t]), -1)[0]) >= 0]

    at = spark.createDataFrame([(w["block"],) for w in whole], "block int")
    own = clicks.join(F.broadcast(at), "block")
    found = stored(own.groupBy("block").applyInPandas(links, "block int, first long, last long, to int"), "links")
    # a link names a block and a time; the entry there is the first one at that time or later
    ask = found.select(F.col("to").alias("block"), (F.col("last") + gap).alias("t"), F.col("block").alias("from_block"), F.col("first").alias("from_first")).filter("block >= 0")
    none = F.lit(None)
    ask = ask.unionByName(spark.createDataFrame(starts, "block int, t long").select("block", "t", none.cast("int").alias("from_block"), none.cast("long").alias("from_first")))

    def resolve(ask: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(ask):
            return ask.assign(first=[])[["from_block", "from_first", "block", "first"]]
        have = np.sort(found["first"].to_numpy(np.int64))
        k = np.searchsorted(have, ask["t"].to_numpy(np.int64), "left")
        return ask.assign(first=have[k])[["from_block", "from_first", "block", "first"]]

    go = ask.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(resolve, "from_block int, from_first long, block int, first long")
    go = stored(go, "resolved")
    reached = go.filter("from_block IS NULL").select("block", "first")
    step = go.filter("from_block IS NOT NULL").select(F.col("from_block").alias("block"), F.col("from_first").alias("first"), F.col("block").alias("b2"), F.col("first").alias("f2"))
    steps = [stored(step, "step")]
    while not steps[-1].isEmpty():  # steps[k] goes 2**k links
        s = steps[-1]
        steps.append(stored(s.join(s.select(F.col("block").alias("b2"), F.col("first").alias("f2"), F.col("b2").alias("b3"), F.col("f2").alias("f3")), ["b2", "f2"]).select("block", "first", F.col("b3").alias("b2"), F.col("f3").alias("f2")), "step"))
    for s in reversed(steps[:-1]):
        reached = stored(reached.unionByName(reached.join(s, ["block", "first"]).select(F.col("b2").alias("block"), F.col("f2").alias("first"))).distinct(), "reached")
    return {r["block"]: r["last"] for r in reached.join(found, ["block", "first"]).groupBy("block").agg(F.max("last").alias("last")).collect()}


def debounce(clicks: DataFrame, gap_ms: int = 2000, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """clicks: session_id, label, ms, id.  session_id and id of those that are kept."""
    spark = clicks.sparkSession
    own = clicks.select("session_id", "label", F.col("ms").cast("long").alias("ms"), "id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    n = own.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n // block_rows)))
    order = [F.asc_nulls_first("session_id"), F.col("ms"), F.col("id")]
    dealt = own.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.mapInArrow(_folded(gap_ms), f"{kinds}, block int, at long, kept boolean"), "clicks")
    known = dealt.filter("kept").select("session_id", "id")
    ends = dealt.groupBy("block").agg(
        F.count_if(F.col("kept").isNull()).alias("waiting"), F.count("*").alias("n"), F.min_by(F.struct("session_id", "label", "ms"), "at").alias("a"), F.max_by(F.struct("session_id", "label", "ms"), "at").alias("z"),
        F.max(F.when(F.col("kept"), F.struct("at", "ms"))).alias("k"),
    )
    rows = [r.asDict(recursive=True) for r in ends.orderBy("block").collect()]  # a row for each block
    same = lambda a, b: a["session_id"] == b["session_id"] and a["label"] == b["label"] and a["label"] is not None

    # blocks that wait as a whole, in chains
    whole, chain = [], -1
    for i, r in enumerate(rows):
        r["whole"] = r["waiting"] == r["n"]
        if not r["whole"]:
            continue
        before = rows[i - 1] if i else None
        goes_on = before is not None and same(before["z"], r["a"])
        root = not (goes_on and before["whole"])
        chain += root
        head = before["k"]["ms"] if goes_on and not before["whole"] else None
        whole.append({"block": r["block"], "chain": chain, "root": root, "head": head, "first": r["a"]["ms"], "last": r["z"]["ms"]})
    chained = any(a["whole"] and same(a["z"], b["a"]) for a, b in zip(rows, rows[1:], strict=False))  # a block goes on from one that waits
    last = _reached(spark, dealt, whole, gap_ms) if chained else {}

    # the time of the kept click that each block goes on from; null where its first click is kept
    carry, before = {}, None
    for r in rows:
        goes_on = before is not None and same(before["z"], r["a"])
        carry[r["block"]] = before["carry"] if goes_on else None
        if not r["whole"]:
            r["carry"] = r["k"]["ms"]
        else:
            r["carry"] = last.get(r["block"], carry[r["block"]])
        before = r

    def rest(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        held, keep = carry[int(key[0])], []
        for ms in rows["ms"].tolist():
            keep.append(held is None or ms - held >= gap_ms)
            held = ms if keep[-1] else held
        return rows.loc[keep, ["session_id", "id"]]

    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    waiting = dealt.filter("kept IS NULL").groupBy("block").applyInPandas(rest, f"session_id {kind['session_id']}, id {kind['id']}")
    return known.unionByName(waiting)
