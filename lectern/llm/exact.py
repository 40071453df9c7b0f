"""Exact duplicates by a log-structured merge index over digests.

Each task fills memtables with (digest, identifier); a full one is flushed as a sorted run, which has a digest once, with
its best identifier and its number of rows, so the copies of a text cost one entry a run however hot the text is. Runs are
cut into ranges of digests. A range puts its runs through a filter that tells which digests no other run holds: those are
settled at once. The rest is compacted by levels: ``FAN`` runs of a level become one of the next, and of equal digests
the best identifier stays. Digests of several rows are the hits. A Bloom filter of all hits is held against the digest of
every row, so that only rows that may be hits go further: they look up their digest, and their texts are verified by bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm.skew import join_entries
from lectern.llm.store import table
from lectern.llm.textbytes import as_bytes

#: Bytes of a text's SHA-256 that the index goes by; texts that share them are told apart when hits are verified.
KEY = 16
#: Rows of a memtable, runs merged at a time, rows of a range.
MEMTABLE, FAN, RANGE = 200_000, 4, 1 << 20
#: The filter of hits has 16 bits a hit, up to 8 MB; beyond, it lets more rows through.
FILTER_BITS = 1 << 26

Run = dict[str, np.ndarray]
PACKET = "range bigint, k1 binary, k2 binary, best binary, named binary, n binary"


def _merge(runs: list[Run], largest: bool) -> Run:
    """One sorted run of all: of equal digests the best identifier, and all rows."""
    x = {c: np.concatenate([r[c] for r in runs]) for c in runs[0]}
    order = np.lexsort((~x["best"] if largest else x["best"], ~x["named"], x["k2"], x["k1"]))
    x = {c: v[order] for c, v in x.items()}
    new = np.ones(len(order), bool)
    new[1:] = (x["k1"][1:] != x["k1"][:-1]) | (x["k2"][1:] != x["k2"][:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(x["n"], first) if len(first) else x["n"]
    return {c: v[first] for c, v in x.items()} | {"n": total}


def _memtables(ranges: int, largest: bool):
    """Sorted runs, cut into ranges, from batches of (identifier, digest)."""

    def flush(memtable: list[Run]) -> pa.RecordBatch:
        run = _merge(memtable, largest)
        part = (run["k1"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        edges = B.runs(part).tolist()
        spans = list(zip(edges, [*edges[1:], len(part)]))
        pack = {"k1": B.pack, "k2": B.pack_any, "best": lambda x: B.pack_any(x.view(np.uint64)), "named": B.pack_bits, "n": B.pack_any}
        columns = {"range": pa.array([int(part[i]) for i, _ in spans], pa.int64())} | {c: pa.array([f(run[c][i:j]) for i, j in spans], pa.binary()) for c, f in pack.items()}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable: list[Run] = []
        size = 0
        for batch in batches:
            keys = as_bytes(batch.column(1))[0].reshape(-1, 16).view(">u8").astype(np.uint64)
            named = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            best = batch.column(0).fill_null(0).to_numpy()
            memtable.append({"k1": keys[:, 0], "k2": keys[:, 1], "best": best, "named": named, "n": np.ones(len(best), np.int64)})
            size += len(best)
            if size >= MEMTABLE:
                yield flush(memtable)
                memtable, size = [], 0
        if size:
            yield flush(memtable)

    return run


def settled(runs: list[Run]) -> list[np.ndarray]:
    """Of each run the digests that no other run holds, but for some that the filter can't tell."""
    bits = 1 << max(6, (16 * sum(len(r["k1"]) for r in runs)).bit_length())
    mask = np.uint64(bits - 1)
    places = [(r["k2"] & mask, (r["k1"] ^ (r["k2"] >> np.uint64(31))) & mask) for r in runs]
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
    for both in places:
        for p in both:
            twice[p] |= once[p]
        for p in both:
            once[p] = True
    return [~(twice[p] & twice[q]) for p, q in places]


def compact(runs: list[Run], largest: bool) -> Run:
    """The digests of several rows of all runs."""
    several, levels = [], {0: []}
    for run, alone in zip(runs, settled(runs)):
        mine = alone & (run["n"] > 1)
        several.append({c: v[mine] for c, v in run.items()})
        level, run = 0, {c: v[~alone] for c, v in run.items()}
        levels[0].append(run)
        while len(levels[level]) == FAN:
            run = _merge(levels.pop(level), largest)
            level += 1
            levels.setdefault(level, []).append(run)
            levels.setdefault(0, [])
    rest = _merge([r for level in levels.values() for r in level] or [{c: v[:0] for c, v in runs[0].items()}], largest)
    several.append({c: v[rest["n"] > 1] for c, v in rest.items()})
    return {c: np.concatenate([r[c] for r in several]) for c in several[0]}


def _compact(largest: bool):
    def run(t: pa.Table) -> pa.Table:
        runs = []
        for k1, k2, best, named, n in zip(*(t.column(c).to_pylist() for c in ("k1", "k2", "best", "named", "n"))):
            x = B.unpack(k1)
            runs.append({"k1": x, "k2": B.unpack_any(k2), "best": B.unpack_any(best).view(np.int64), "named": B.unpack_bits(named, len(x)), "n": B.unpack_any(n).view(np.int64)})
        hits = compact(runs, largest)
        size = len(hits["n"])
        keys = np.column_stack([hits["k1"], hits["k2"]]).astype(">u8").tobytes()
        at = pa.py_buffer(np.arange(size + 1, dtype=np.int32) * 16)
        return pa.table({"key": pa.Array.from_buffers(pa.binary(), size, [None, at, pa.py_buffer(keys)]), "keep_id": pa.array(hits["best"], mask=~hits["named"]), "group_size": pa.array(hits["n"])})

    return run


def _filter(hits: DataFrame, count: int) -> Callable[[Column], Column]:
    """A test that every key of ``hits`` passes and few others do: a Bloom filter in whole words, at most FILTER_BITS."""
    bits = min(FILTER_BITS, max(64, 1 << (16 * count).bit_length()))
    places = lambda key: [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in (1, 2)]
    word, bit = lambda p: F.shiftright(p, 6).cast("int"), lambda p: F.pmod(p, F.lit(64)).cast("int")
    set_ = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("p")))
    some = hits.select(F.explode(F.array(*places(F.col("key")))).alias("p")).groupBy(word(F.col("p")).alias("w")).agg(F.bit_or(set_).alias("b"))
    every = hits.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("b"))
    filled = some.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    words = table(filled.agg(F.array_sort(F.collect_list(F.struct("w", "b")))["b"].alias("words")), "filter").scalar()

    def test(key: Column) -> Column:
        out = F.lit(True)
        for p in places(key):
            out = out & (F.getbit(F.get(words, word(p)), bit(p)) == 1)
        return out

    return test


def exact_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "largest", verify: bool = True, key_bytes: int = KEY) -> DataFrame:
    """One row for each row of ``df``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their bytes are; null counts as empty. ``keep`` is "largest" or "smallest": which identifier of
    equal texts stays. Null identifiers lose against any other, and a group of null identifiers only has a null
    ``keep_id`` and keeps its rows. Repeated rows (same text and id) share a verdict and count in ``group_size``. An
    empty table gives an empty result. With ``verify``, rows whose digests agree in ``key_bytes`` and whose bytes differ
    are grouped by their texts; ``key_bytes`` from 1 to 16 changes no result then.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    largest = keep == "largest"
    best = F.max if largest else F.min
    base = df.select(F.col(f"`{id}`").cast("bigint").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    key = F.concat(F.substring(F.col("digest"), 1, key_bytes), F.lit(bytes(16 - key_bytes)))
    digest = F.unhex(F.sha2(F.col("_text"), 256))
    rows = table(base.select("_id", digest.alias("digest")), "digests")
    total = rows.count()
    ranges = max(1, math.ceil(total / RANGE))
    runs = rows.select("_id", key.alias("key")).mapInArrow(_memtables(ranges, largest), PACKET)
    hits = table(runs.groupBy("range").applyInArrow(_compact(largest), "key binary, keep_id bigint, group_size bigint"), "hits")
    maybe = _filter(hits, hits.count())

    rows = rows.withColumn("key", key)
    out = rows.where(~maybe(F.col("key"))).select("_id", "digest", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    told = join_entries(rows.where(maybe(F.col("key"))), hits, "key", F.col("group_size"), total)
    told = told.select("key", "_id", "digest", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    if verify:
        texts = base.withColumn("digest", digest).withColumn("key", key).where(maybe(F.col("key")))
        groups = texts.groupBy("key", "_text").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
        clash = table(groups.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "clashes")
        if not clash.isEmpty():
            told = told.join(clash, "key", "left_anti")
            apart = texts.join(clash, "key", "left_semi").select("_id", "digest", "_text")
            groups = groups.join(clash, "key", "left_semi").select(F.col("_text").alias("t"), "keep_id", "group_size")
            out = out.unionByName(apart.join(groups, F.col("_text") == F.col("t")).select("_id", "digest", "keep_id", "group_size"))
    out = out.unionByName(told.select("_id", "digest", "keep_id", "group_size"))
    kept = F.coalesce(F.col("_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select(F.col("_id").alias(id), "keep_id", F.col("group_size").cast("bigint").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
