"""Whole columns of text as one array of bytes: words, line and word hashes, n-grams, all vectorised.

A word is a run of bytes other than space and 0x09-0x0D. Those six never occur inside a UTF-8 sequence, so
byte-wise splitting equals splitting by code point.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CHUNK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Polynomial hashes modulo 2**64 of byte spans, read off one prefix sum. Fast, but long texts can be made to collide:
    for features of short spans only, where nothing is decided by equality. ``Words.hashes`` is for the rest."""

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.base = int(mix(np.array([seed + 77], np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK + 4096)
            for name, by in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, by, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def spans(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each ``b[start:end]``."""
        self._grow(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.byte[b] * self.up[: len(b)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))


FEATURE = Hasher(1)
#: Words of up to so many bytes are told apart without a digest; masks of the low bytes of 64 bits; keys of mixing rounds.
INLINE = 15
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
ROUNDS = mix(np.arange(2001, 2007, dtype=np.uint64))
#: Odd multipliers of the two halves of a word's hash in the hash of a run of words.
GRAM = tuple(int(x) | 1 for x in mix(np.array([992, 993], np.uint64)))


def grams(h: np.ndarray, k: int, half: int = 0) -> np.ndarray:
    """A hash of each run of ``k`` of the words' hashes; one for each start, none if there are fewer.

    A linear form of hashes that behave like random numbers: runs that differ in any word collide one time in 2**64.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = h[:n].copy()
    for i in range(1, k):
        x *= np.uint64(GRAM[half])
        x += h[i : i + n]
    return mix(x)


def distinct_spans(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each of the spans, which follow each other without overlap, the number of its distinct value; and those values. Compared by bytes."""
    edge = np.zeros(len(b) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    data = b[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    spans = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return spans.indices.to_numpy(), spans.dictionary


class Words:
    """The words of a run of documents: ``start``, ``end`` in bytes, and ``first[d]:first[d+1]`` those of document d."""

    def __init__(self, b: np.ndarray, offsets: np.ndarray):
        self.b, self.offsets = b, offsets
        inside = ~SEPARATOR[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """For each word the number of its distinct word, and the distinct words."""
        return distinct_spans(self.b, self.start, self.end)

    def hashes(self) -> np.ndarray:
        """128 bits for each word, as two rows of 64. Words up to ``INLINE`` bytes have one of their own, as each is put
        through a bijection of 128 bits with its length; the rare longer ones have BLAKE2b's, once for each distinct one."""
        size = self.end - self.start
        padded = np.zeros(len(self.b) + 16, np.uint8)
        padded[: len(self.b)] = self.b
        eight = np.ndarray(len(self.b) + 9, "<u8", padded, strides=(1,))
        x = eight[self.start] & KEEP[np.minimum(size, 8)]
        y = eight[self.start + 8] & KEEP[np.clip(size - 8, 0, 7)] | (size.astype(np.uint64) << np.uint64(56))
        for key in ROUNDS:  # a Feistel network
            x, y = y, x ^ mix(y + key)
        out = np.stack([x, y])
        long = np.flatnonzero(size > INLINE)
        if len(long):
            at, words = distinct_spans(self.b, self.start[long], self.end[long])
            digests = b"".join([blake2b(w, digest_size=16).digest() for w in words.to_pylist()])
            out[:, long] = np.frombuffer(digests, np.uint64).reshape(-1, 2).T[:, at]
        return out

    def gram_starts(self, k: int) -> np.ndarray:
        """Whether ``k`` words of one document start at each word that a gram can start at."""
        n = max(0, len(self.start) - k + 1)
        ok = np.ones(n, bool)
        for f in self.first[1:]:
            ok[max(0, f - k + 1) : f] = False
        return ok


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows ``i:j`` of about ``limit`` bytes, with their bytes and offsets."""
    b, o = as_bytes(column)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, "right")) - 1)
        yield i, j, b[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def release() -> None:
    """Gives memory that long texts took back to the system: a worker of Python stays when its task has ended."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over ``first[d]:first[d+1]``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
