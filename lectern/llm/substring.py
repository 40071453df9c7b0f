"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Every block of documents (``blocks``) adds to the reference. A first exchange tells which windows of ``least`` words any
other document has; only those enter the index, in ranges of hashes, by 128 bits: the reference holds each of them once,
at the first place (id, word) where it occurs over all blocks. As a window has one place there, the longest agreement of a
document with the reference from some word on is read off the places of the windows from that word: they follow each
other for as long as the texts agree. A document is parsed greedily: at a word whose window is not in the reference it
emits a literal and moves on by one word; else a factor that goes as far as the texts agree, and the next one begins
where it ends. Windows across the end of a factor belong to none, so they are looked up by themselves. What factors and
those windows cover is duplicate. Only ids less than a document's own count as sources, and windows are judged on the
input. At 100 TB (2e13 windows) 128 bits collide once in 1e12 runs, so hits are not compared again by their words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm.textbytes import Words, chunks, grams

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 13


def windows(docs: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: row, word at which it starts, and the two halves of its hash."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i, _, b, o in chunks(docs.column("_text").combine_chunks()):
        w = Words(b, o)
        at = np.flatnonzero(w.gram_starts(k))
        row = w.doc()[at]
        h = w.hashes()
        for to, x in zip(out, (row + i, at - w.first[row], grams(h[0], k)[at], grams(h[1], k, 1)[at])):
            to.append(x)
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, kinds))  # type: ignore[return-value]


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("_id").combine_chunks().fill_null(0).to_numpy() if docs.num_rows else np.zeros(0, np.int64)


def _filter_keys(docs: pa.Table, h: np.ndarray, row: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct split hashes, whether documents of several ids have each, and the place of each window among them."""
    keys, ids = B.split(h, ranges), _ids(docs)[row]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = B.runs(ordered)
    owner = ids[order]
    many = np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at) if len(at) else np.zeros(0, bool)
    where = np.empty(len(keys), np.int64)
    where[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(keys))))
    return ordered[at], many, where


def _send(k: int, ranges: int):
    def send(docs: pa.Table) -> pa.Table:
        row, _, h, _ = windows(docs, k)
        distinct, many, _ = _filter_keys(docs, h, row, ranges)
        low = distinct & np.uint64(0xFFFFFFFF)
        parts = B.by_range(distinct)
        block = docs.column("block")[0].as_py()
        return pa.table({"range": pa.array([r for r, _, _ in parts], pa.int64()), "block": pa.array([block] * len(parts), pa.int32()), "low": pa.array([B.pack(low[i:j]) for _, i, j in parts], pa.binary()), "many": pa.array([B.pack_bits(many[i:j]) for _, i, j in parts], pa.binary())})

    return send


def _answer(t: pa.Table) -> pa.Table:
    low = [B.unpack(x) for x in t.column("low").to_pylist()]
    packets = [(v, B.unpack_bits(m, len(v))) for v, m in zip(low, t.column("many").to_pylist())]
    return pa.table({"range": t.column("range"), "block": t.column("block"), "shared": pa.array([B.pack_bits(x) for x in B.shared_in_range(packets)], pa.binary())})


def _first_of(h: np.ndarray, h2: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, then id, then place; and where in it each hash begins."""
    order = np.lexsort((at, ids, h2, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    return order, np.flatnonzero(new)


ENTRY = "range bigint, block int, h binary, h2 binary, id binary, at binary, many binary"


def _index(k: int, ranges: int):
    """What a block adds to the reference: of each window that the filter lets through its first place in the block."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        row, start, h, h2 = windows(docs, k)
        distinct, _, where = _filter_keys(docs, h, row, ranges)
        bits = dict(zip(answers.column("range").to_pylist(), answers.column("shared").to_pylist()))
        flags = np.concatenate([B.unpack_bits(bits[r], j - i) for r, i, j in B.by_range(distinct)]) if len(distinct) else np.zeros(0, bool)
        go = flags[where]
        h, h2, ids, start = h[go], h2[go], _ids(docs)[row[go]], start[go]
        order, first = _first_of(h, h2, ids, start)
        greatest = ids[order[np.append(first[1:], len(order)) - 1]] if len(first) else ids
        order = order[first]
        h, h2, ids, start = h[order], h2[order], ids[order], start[order]
        many = ids < greatest
        part = (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        edges = B.runs(part).tolist()
        spans = list(zip(edges, [*edges[1:], len(h)]))
        block = docs.column("block")[0].as_py() if docs.num_rows else None
        pack = lambda f, x: pa.array([f(x[i:j]) for i, j in spans], pa.binary())
        return pa.table({
            "range": pa.array([int(part[i]) for i, _ in spans], pa.int64()),
            "block": pa.array([block] * len(spans), pa.int32()),
            "h": pack(B.pack, h),
            "h2": pack(B.pack_any, h2),
            "id": pack(B.pack_any, ids.view(np.uint64)),
            "at": pack(B.pack_any, start),
            "many": pack(B.pack_bits, many),
        })

    return run


FOUND = "range bigint, block int, h binary, h2 binary, source binary, at binary"


def _merge(t: pa.Table) -> pa.Table:
    """The reference of a range: each window once, where it first occurs over all blocks. It goes back to the blocks that have it in a later document."""
    column = lambda c: t.column(c).to_pylist()
    h = [B.unpack(x) for x in column("h")]
    sizes = [len(x) for x in h]
    every = np.concatenate(h)
    second, ids, at = (np.concatenate([B.unpack_any(x) for x in column(c)]) for c in ("h2", "id", "at"))
    ids = ids.view(np.int64)
    many = np.concatenate([B.unpack_bits(x, n) for x, n in zip(column("many"), sizes)])
    order, first = _first_of(every, second, ids, at)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
    back = many | (ids[least] < ids)
    out: dict[str, list[bytes]] = {c: [] for c in ("h", "h2", "source", "at")}
    i = 0
    for n in sizes:
        go = np.flatnonzero(back[i : i + n]) + i
        out["h"].append(B.pack(every[go]))
        for c, x in (("h2", second[go]), ("source", ids[least[go]].view(np.uint64)), ("at", at[least[go]])):
            out[c].append(B.pack_any(x))
        i += n
    return pa.table({"range": t.column("range"), "block": t.column("block")} | {c: pa.array(x, pa.binary()) for c, x in out.items()})


def look_up(keys: np.ndarray, seconds: np.ndarray, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where each pair of hashes stands among the keys, sorted by the first; -1 where it doesn't."""
    at = np.searchsorted(keys, h)
    out = np.full(len(h), -1)
    todo = np.flatnonzero(at < len(keys))
    while len(todo):
        todo = todo[keys[at[todo]] == h[todo]]
        hit = seconds[at[todo]] == h2[todo]
        out[todo[hit]] = at[todo[hit]]
        todo = todo[~hit]
        at[todo] += 1  # another window with the same first half
        todo = todo[at[todo] < len(keys)]
    return out


def factorise(start: np.ndarray, source: np.ndarray, at: np.ndarray, k: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Greedy parse of one document, from its windows that stand in the reference, by start, with their one place there.

    Factors (start, length, source, place) go as far as text and reference agree, and none overlaps another; all other
    words are literals. A window that begins in a factor and ends after it is no part of any: those found in the reference
    are returned by start.
    """
    n = len(start)
    on = (start[1:] == start[:-1] + 1) & (source[1:] == source[:-1]) & (at[1:] == at[:-1] + 1)
    ends = np.append(np.flatnonzero(~on), n - 1)  # the last window of each stretch of agreement
    factors, straddling, i = [], [], 0
    while i < n:
        j = int(ends[np.searchsorted(ends, i)])
        end = int(start[j]) + k
        factors.append((int(start[i]), end - int(start[i]), int(source[i]), int(at[i])))
        i = int(np.searchsorted(start, end))
        straddling += start[j + 1 : i].tolist()
    return factors, straddling


def _parse(k: int, digest: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        row, start, h, h2 = windows(docs, k)
        parts = sorted(zip(*(answers.column(c).to_pylist() for c in ("range", "h", "h2", "source", "at"))))
        none = np.zeros(0, np.uint64)
        keys = np.concatenate([none, *(B.unpack(x[1]) for x in parts)])
        seconds, source, place = (np.concatenate([none, *(B.unpack_any(x[c]) for x in parts)]) for c in (2, 3, 4))
        found = look_up(keys, seconds, h, h2)
        hit = np.flatnonzero(found >= 0)
        hit = hit[source.view(np.int64)[found[hit]] < _ids(docs)[row[hit]]]
        found = found[hit]
        return _result(docs, k, digest, row[hit], start[hit], source.view(np.int64)[found], place.view(np.int64)[found])

    return run


FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("at", pa.int32())]))


def _result(docs: pa.Table, k: int, digest: bool, row: np.ndarray, start: np.ndarray, source: np.ndarray, at: np.ndarray) -> pa.Table:
    first = np.searchsorted(row, np.arange(docs.num_rows + 1))
    words, removed, kept, every, boundary = [], [], [], [], []
    for d, text in enumerate(docs.column("_text").to_pylist()):
        w = WORD.findall(text or "")
        i, j = first[d], first[d + 1]
        factors, straddling = factorise(start[i:j], source[i:j], at[i:j], k) if i < j else ([], [])
        stay = w
        if factors:
            cover = np.zeros(len(w) + 1, np.int64)
            spans = np.array([(s, s + n) for s, n, *_ in factors] + [(s, s + k) for s in straddling])
            np.add.at(cover, spans[:, 0], 1)
            np.add.at(cover, spans[:, 1], -1)
            stay = list(compress(w, (np.cumsum(cover)[:-1] == 0).tolist()))
        words.append(len(w))
        removed.append(len(w) - len(stay))
        kept.append(" ".join(stay))
        every.append([dict(zip(("start", "length", "source", "at"), f)) for f in factors])
        boundary.append(straddling)
    out = [hashlib.sha256(x.encode()).hexdigest() for x in kept] if digest else kept
    return pa.table({
        "_id": docs.column("_id"),
        "n_words": pa.array(words, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept": pa.array(out, pa.string()),
        "factors": pa.array(every, FACTOR),
        "straddling": pa.array(boundary, pa.list_(pa.int32())),
    })


def _untouched(k: int, digest: bool):
    """The result of rows that lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            yield from _result(pa.Table.from_batches([batch]), k, digest, none, none, none, none).to_batches()

    return run


def substring_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, digest: bool = False) -> DataFrame:
    """One row for each row of ``df``: id, ``n_words``, ``n_removed``, what stays, ``factors`` (start, length, source, at)
    and ``straddling`` (starts of windows across the ends of factors that stand in the reference too).

    A word goes if a window of ``least`` words that covers it also starts in a document of a smaller id. What stays is
    ``kept_text``, words joined by one space, or with ``digest`` its SHA-256 ``kept_sha256``. Null and empty texts have
    no words. Rows that repeat an id are no sources for each other; rows without id lose nothing and are no source.
    Repeats inside one document stay. Texts of fewer words than ``least`` lose nothing. An empty table gives an empty
    result.
    """
    base = df.select(F.col(f"`{id}`").cast("bigint").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    count, ranges = B.layout(base, "_text")
    named = base.where("_id is not null").withColumn("block", B.block_of(F.xxhash64("_id", "_text"), count))
    group = named.groupBy("block")
    sent = group.applyInArrow(_send(least, ranges), "range bigint, block int, low binary, many binary")
    shared = sent.groupBy("range").applyInArrow(_answer, "range bigint, block int, shared binary")
    entries = group.cogroup(shared.groupBy("block")).applyInArrow(_index(least, ranges), ENTRY)
    found = entries.groupBy("range").applyInArrow(_merge, FOUND)
    factor = "array<struct<start:int,length:int,source:bigint,at:int>>"
    schema = f"_id bigint, n_words bigint, n_removed bigint, kept string, factors {factor}, straddling array<int>"
    out = group.cogroup(found.groupBy("block")).applyInArrow(_parse(least, digest), schema)
    out = out.unionByName(base.where("_id is null").mapInArrow(_untouched(least, digest), schema))
    return out.withColumnsRenamed({"_id": id, "kept": "kept_sha256" if digest else "kept_text"})
