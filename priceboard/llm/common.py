"""What the document operators share: word hashing and column helpers; and the folder for intermediate tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored  # noqa: F401

#: White space between words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def packed(df: DataFrame, **names: str) -> DataFrame:
    """The whole row as __row, and chosen columns under private names, so that no column of the input can clash."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("__row"), *(df[f"`{c}`"].alias(k) for k, c in names.items()))


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE + "+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than it must to tell."""
    return df.limit(limit + 1).count() <= limit


class WordHash(dict):
    """bytes -> 64-bit hash, remembered for the words met most lately; bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift); wraps round."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : len(h) - n + 1 + i]
    return mix(out)


def byte_blocks(texts: pa.Array, limit: int):
    """Bounds (a, b) of runs of texts with about limit bytes, so that the memory of a task follows bytes and not rows."""
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for b, n in enumerate(lengths, 1):
        size += n
        if size >= limit or b == len(lengths):
            yield start, b
            start, size = b, 0
