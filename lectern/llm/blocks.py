"""Which fingerprints occur in more than one document, found without moving a row for each fingerprint.

Documents are dealt by a hash of their id to blocks of bounded size. A block sends, for each range of fingerprints, one
packet: its distinct fingerprints of that range, sorted, as differences in byte planes (about three bytes each after
the shuffle's compression). A range merges the packets of all blocks and answers each with one bit a fingerprint:
whether another document has it. A fingerprint that a third of all documents hold is one entry a block, so hot ones cost
no more than others. Ranges and blocks are counted from the size of the input, so both stay bounded at any size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's texts and fingerprints of a range up to ``LEVEL`` bytes of input. Beyond, both grow as the root of
#: the input, up to ``MOST`` times, so that a packet, one block's part of one range, keeps its size for as long as tasks can hold both.
BLOCK_BYTES, RANGE_ITEMS = 3 << 20, 1 << 20
LEVEL, MOST = 30 << 30, 8


def layout(df: DataFrame, text: str) -> tuple[int, int]:
    """(blocks, ranges) for all texts of ``df``, a word counted as six bytes."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    grown = min(MOST, max(1.0, math.sqrt(total / LEVEL)))
    return max(1, math.ceil(total / BLOCK_BYTES / grown)), max(1, math.ceil(total / 6 / RANGE_ITEMS / grown))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def split(h: np.ndarray, ranges: int) -> np.ndarray:
    """A 64-bit hash as range (upper half) and fingerprint (lower half); sorted as one number it sorts by range first."""
    high = h >> np.uint64(32)
    return ((high * np.uint64(ranges)) & np.uint64(0xFFFFFFFF00000000)) | (h & np.uint64(0xFFFFFFFF))


def pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers, least first, as byte planes of their differences."""
    if not len(values):
        return b""
    d = np.empty(len(values), np.uint64)
    d[0] = values[0]
    np.subtract(values[1:], values[:-1], out=d[1:])
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :width] = planes.T
    return np.cumsum(d.view(np.uint64).ravel())


def pack_any(values: np.ndarray) -> bytes:
    """Whole numbers in any order, as byte planes."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() if len(values) else b""


def unpack_any(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel() if data else np.zeros(0, np.uint64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first)


def by_range(distinct: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, i, j) of the runs of a sorted array of split hashes."""
    r = distinct >> np.uint64(32)
    at = runs(r)
    return list(zip(r[at].tolist(), at.tolist(), [*at[1:].tolist(), len(distinct)]))


def shared_in_range(packets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each packet (distinct fingerprints, whether several of its own documents have each): which are shared."""
    every = np.concatenate([v for v, _ in packets]) if packets else np.zeros(0, np.uint64)
    order = np.sort(every)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return [many for _, many in packets]
    twice = twice[runs(twice)]
    return [many | (twice[np.minimum(np.searchsorted(twice, v), len(twice) - 1)] == v) for v, many in packets]


def levels_in_range(packets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each packet's fingerprints 0 if no other document has them, else one more than the logarithm of the blocks that do."""
    if not packets:
        return []
    every = np.sort(np.concatenate([v for v, _ in packets]))
    at = runs(every)
    distinct = every[at]
    level = np.floor(np.log2(np.diff(np.append(at, len(every))))).astype(np.uint8)
    of_many = [v[m] for v, m in packets]
    own = np.unique(np.concatenate(of_many))
    level[level > 0] += 1
    twice = np.zeros(len(distinct), bool)
    twice[np.searchsorted(distinct, own)] = True
    level[twice & (level == 0)] = 1  # several documents of one block: the same for all blocks that have it
    return [level[np.searchsorted(distinct, v)] for v, _ in packets]
