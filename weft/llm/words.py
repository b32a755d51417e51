"""Hashes of the words of many texts at once, straight from Arrow's buffers.

A word is a longest run of bytes other than space and 0x09-0x0D, which are single bytes in UTF-8 as well.
Equal words have equal hashes in every process, and different words of whatever build differ but by a chance of
2**-64: each step is a bijection of the bytes and of all that was before, not a sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = 2**64 - 1
#: Words longer than this many bytes are hashed one by one, by blake2b.
SHORT = 256
#: Bytes of text in one slab; a longer text is a slab of its own.
SLAB = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + U((seed * _ODD + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 places where its texts start; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    wide = np.int64 if column.type == pa.large_string() else np.int32
    _, at, data = column.buffers()
    places = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def slabs(batch: pa.RecordBatch, text: int, most: int = SLAB) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each."""
    _, places = bytes_of(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(places, places[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def words_of(data: np.ndarray, places: np.ndarray, lower: bool = False, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, and the n+1 places where each text's words start among them."""
    if lower:
        data = LOWER[data]
    inside = IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[places] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (cut[:-1] | ~before))
    end = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
    return hashes(data, start, end) if hashed else np.zeros(0, np.uint64), start, end, np.searchsorted(start, places)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of data[start:end]: eight bytes at a time go through a bijection that mixes every bit."""
    size = end - start
    out = mix(size.astype(np.uint64), 1)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= SHORT))
    at, rest = start[left], size[left]
    while len(left):
        block = eight[at]
        last = rest < 8
        block[last] &= (U(1) << (rest[last].astype(np.uint64) * U(8))) - U(1)
        out[left] = mix(out[left] * U(_ODD) ^ block, 2)
        more = np.flatnonzero(rest > 8)
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    for i in np.flatnonzero(size > SHORT):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of k words (len(words) - k + 1 of them, none if there are fewer); a function of its own for each seed."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed * _ODD & _MASK, np.uint64)
    for j in range(k):
        out += words[j : j + n]
        out *= U(_ODD)
        out ^= out >> U(29)
    return mix(out, seed + k)


def joined(runs: np.ndarray, at: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of what the runs at each place and those offsets from it hash to."""
    out = np.zeros(len(at), np.uint64)
    for o in offsets:
        out += runs[at + o]
        out *= U(_ODD)
        out ^= out >> U(29)
    return mix(out, len(offsets))


def sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every k neighbours (len(x) - k + 1 of them), by doubling."""
    p = 1
    out = x
    while 2 * p <= k:
        out = np.minimum(out[:-p], out[p:])
        p *= 2
    return np.minimum(out[: len(x) - k + 1], out[k - p :]) if k > p else out


def signed(x: np.ndarray) -> pa.Array:
    """64-bit numbers as Spark's long."""
    return pa.array(x.view(np.int64))
