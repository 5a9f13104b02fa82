"""Permutation-filled lookup table: constant-time placement of documents on shards.

Every shard walks its own permutation of a prime number of slots; the shards take turns, each
claiming the first slot of its order that is still free, until the table is full.  A document's key
is hashed to a slot and the slot names the shard.  Shares differ by at most one slot, and a change
of the set of shards moves little more than the share of the shards that came or went.

The table depends on the parameters alone and has at most MAX_SLOTS rows, which bounds what is
broadcast; placing a document takes one hash and one probe, without a shuffle.

Defined cases: a null key is placed by the hash of the text (so such rows do not pile up on one
shard); null key and null text go to the slot of the empty text; a text is
hashed whole, however long, and only where the key is null; repeated rows and repeated keys go
to one shard; an empty table gives an empty result; extra columns pass through, also when they are
called ``slot`` or ``shard`` (the new column then replaces them).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed

N_SHARDS = 64
N_SLOTS = 65_537
MAX_SLOTS = 1 << 20


def _word(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def lookup(shards: list[str], n_slots: int = N_SLOTS) -> list[int]:
    """The filled table: for each slot the index of its shard."""
    if n_slots > MAX_SLOTS or n_slots < max(2, len(shards)) or any(n_slots % k == 0 for k in range(2, int(n_slots**0.5) + 1)):
        raise ValueError(f"n_slots must be a prime from the number of shards to {MAX_SLOTS}")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names")
    at = [_word(s + "/offset") % n_slots for s in shards]
    step = [_word(s + "/skip") % (n_slots - 1) + 1 for s in shards]
    table, free, turn = [-1] * n_slots, n_slots, 0
    while free:
        while table[at[turn]] >= 0:
            at[turn] = (at[turn] + step[turn]) % n_slots
        table[at[turn]] = turn
        free -= 1
        turn = (turn + 1) % len(shards)
    return table


def lookup_table(spark: SparkSession, shards: list[str], n_slots: int = N_SLOTS) -> DataFrame:
    """slot int, shard int; of at most MAX_SLOTS rows."""
    text = F.lit(json.dumps(lookup(shards, n_slots)))
    return spark.range(1).select(F.posexplode(F.from_json(text, "array<int>")).alias("slot", "shard"))


def slot_of(key: Column, text: Column, n_slots: int) -> Column:
    """The slot of a key.  md5 is used because any engine can repeat it."""
    word = F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def shard(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of docs, with slot and shard."""
    table = lookup_table(docs.sparkSession, [f"shard-{i}" for i in range(n_shards)], n_slots)
    table = table.select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    placed = packed(docs, __key=key, __text=text)
    placed = placed.select("__row", slot_of(F.col("__key"), F.col("__text"), n_slots).alias("__slot"))
    # n_slots <= MAX_SLOTS rows of two ints: a proven bound
    joined = placed.join(F.broadcast(table), "__slot")
    kept = [F.col("__row")[c].alias(c) for c in docs.columns if c.lower() not in ("slot", "shard")]
    return joined.select(*kept, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))
