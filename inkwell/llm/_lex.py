"""Vectorised lexing of Arrow string batches: words, their hashes and n-grams.

A word is a maximal run of ASCII letters, digits and non-ASCII characters;
ASCII letters compare without case.  ``WORD_PATTERN`` is the same as a regular
expression over the lower-cased text.  Everything here works on the UTF-8
bytes of a whole batch at once and keeps documents apart by their offsets.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD_PATTERN = "[0-9a-z\\x80-\\U0010ffff]+"
CHUNK_BYTES = 1 << 19

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_a:_b] = True
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * _U(2) + _U(1)
GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer for 64-bit hashes (a bijection)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives the system what earlier tasks of this worker have freed."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    n, (_, off, data) = len(arr), arr.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(off, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: (first, last+1, bytes, offsets)."""
    data, offs = buffers(arr)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``member`` bytes, and the mask."""
    m = member[data]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, z, m
    full = offs[1:] > offs[:-1]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    before[offs[:-1][full]] = False
    start = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[offs[1:][full] - 1] = False
    end = np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1, m


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, mask: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each run; ``mask`` marks exactly the bytes of the runs."""
    if not len(start):
        return np.zeros(0, np.uint64)
    body, size = data[mask], end - start
    if fold:
        body = LOWER[body]
    first = np.cumsum(size) - size
    place = np.arange(len(body)) - np.repeat(first, size)
    h = _BYTE[body]
    h *= _PLACE[place & 4095]
    if place.max(initial=0) > 4095:
        far = np.flatnonzero(place > 4095)
        h[far] *= mix((place[far] >> 12).astype(np.uint64)) | _U(1)
    return mix(np.add.reduceat(h, first) ^ (size.astype(np.uint64) * GRAM[0]))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    start, end, row, mask = spans(data, offs)
    return run_hashes(data, start, end, mask), row


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams and the index of each one's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    g = h[at] * GRAM[1]
    for k in range(1, n):
        g += h[at + k] * GRAM[1 + k % 60] + _U(k)
    return mix(g), at


class HashArray:
    """Values under sorted 64-bit hashes, found by a radix directory."""

    def __init__(self, codes: np.ndarray, *values: np.ndarray):
        keys = mix(codes.astype(np.uint64))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = tuple(v[order] for v in values)
        self.bits = max(4, int(len(keys)).bit_length())
        top = np.arange((1 << self.bits) + 1, dtype=np.float64)
        cut = (self.keys >> _U(64 - self.bits)).astype(np.int64)
        self.at = np.searchsorted(cut, top[:-1]).astype(np.int32)
        self.most = int(np.bincount(cut).max()) if len(cut) else 0

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code, or -1."""
        found = np.full(len(codes), -1, np.int32)
        if not len(self.keys) or not len(codes):
            return found
        h = mix(codes.astype(np.uint64))
        i = self.at[h >> _U(64 - self.bits)]
        last = len(self.keys) - 1
        np.minimum(i, last, out=i)
        k = self.keys[i]
        hit = k == h
        found[hit] = i[hit]
        left = np.flatnonzero(k < h)
        i, h = i[left] + 1, h[left]
        for _ in range(self.most):
            if not len(left):
                break
            np.minimum(i, last, out=i)
            k = self.keys[i]
            hit = k == h
            found[left[hit]] = i[hit]
            more = (k < h) & (i < last)
            left, i, h = left[more], i[more] + 1, h[more]
        return found
