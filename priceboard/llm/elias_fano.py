"""Elias-Fano sequences: sorted numbers in little more than 2 + log2(range / count) bits each.

High parts are unary in a bit vector, low parts are packed; a running count of ones for each 64 bits
serves selection.  Look-ups are vectorised over many queries and read the arrays in place, so the
arrays may lie in a memory-mapped file.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_U = np.uint64
#: position of the k-th set bit of a byte, by byte and k
_IN_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(8, np.uint8)
    out = []
    step = 1 << 16  # a multiple of 8, so slices end on bytes
    for a in range(0, len(values), step):
        bits = (values[a : a + step, None] >> np.arange(width, dtype=_U)) & _U(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


class EliasFano:
    """arrays(): what to store; EliasFano(arrays, n, low_bits) opens them again."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, n: int, width: int):
        self.low, self.high, self.ones, self.n, self.width = low, high, ones, n, width
        self.words = np.lib.stride_tricks.as_strided(low[: len(low) - 7], (len(low) - 7, 8), (1, 1)) if n else None

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        """values: sorted uint64, none above top."""
        n = len(values)
        width = min(56, max(0, (max(1, top) // max(1, n)).bit_length() - 1))
        size = n + (top >> width) + 2
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[(values >> _U(width)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little")
        per_word = _ONES[high].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        ones = (np.cumsum(per_word) - per_word).astype(np.uint32 if n < 2**32 else np.uint64)
        return cls(_pack(values & _U((1 << width) - 1), width), high, ones, n, width)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        bit = i.astype(np.int64) * self.width
        word = np.ascontiguousarray(self.words[bit >> 3]).view(_U)[:, 0]
        return (word >> (bit & 7).astype(_U)) & _U((1 << self.width) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        counts = self.ones.astype(np.int64)
        if zeros:
            counts = np.arange(len(counts)) * 64 - counts
        word = np.searchsorted(counts, k, side="right") - 1
        rest = k - counts[word]
        place, todo = word * 8, np.arange(len(k))
        for _ in range(8):  # to the byte that holds it
            b = self.high[place[todo]]
            n = _ONES[~b if zeros else b]
            on = rest[todo] >= n
            rest[todo[on]] -= n[on]
            todo = todo[on]
            place[todo] += 1
            if not len(todo):
                break
        b = self.high[place]
        return place * 8 + _IN_BYTE[~b if zeros else b, rest]

    def get(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.empty(0, _U)
        return ((self._select(i.astype(np.int64), False) - i).astype(_U) << _U(self.width)) | self.lows(i)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The successor of each value (index of the first number not below it) and whether it is equal."""
        if not len(values) or not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        h = (values >> _U(self.width)).astype(np.int64)
        want = values & _U((1 << self.width) - 1)
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - (h - 1), 0)
        end = self._select(h, True) - h
        todo = np.flatnonzero(at < end)
        while len(todo):
            todo = todo[self.lows(at[todo]) < want[todo]]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        inside = at < end
        hit = np.zeros(len(values), bool)
        hit[inside] = self.lows(at[inside]) == want[inside]
        return at, hit


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a memory-mapped file of the task, which is gone when they are."""
    with tempfile.TemporaryFile() as f:
        spots = []
        for a in arrays:
            f.write(b"\0" * (-f.tell() % 8))
            spots.append(f.tell())
            f.write(a.tobytes())
        f.write(b"\0" * 8)
        f.flush()
        view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(view, a.dtype, len(a), spot) for a, spot in zip(arrays, spots, strict=True)]
