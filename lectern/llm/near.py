"""Near duplicates: all pairs of documents whose shingle sets reach a Jaccard similarity, by T-occurrence search.

1. A first exchange (``blocks``) tells of each shingle whether another document has it. A document links with another
   only if the threshold's share of its own shingles is shared, so most documents end here.
2. Of the rest, documents of equal sets form classes; one document stands for each.
3. Representatives of like size that share a shingle of their prefixes (the first n - ceil(t n) + 1 in one order of all
   shingles, by how many blocks have them, rare ones first: linked sets must share one) belong to one candidate cluster.
4. Each cluster is searched by T-occurrence: a document's inverted lists, shortest first; the L = T / (MU log2 M + 1)
   longest are set aside (DivideSkip, M being the longest's length), the others are merged by a heap that skips ahead
   where fewer than T - L can meet, and the documents found there are probed in the long lists by binary search. Clusters
   beyond one task's share are cut by size of set into parts, and parts whose sizes may link are searched against each other.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks as B
from lectern.llm.components import components
from lectern.llm.skew import join_entries
from lectern.llm.store import table
from lectern.llm.textbytes import Words, chunks, grams, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
K = 5
CLUSTER_ITEMS = 300_000
#: DivideSkip sets T / (MU log2(longest list) + 1) of the lists aside as long ones.
MU = 0.01
#: Postings up to which short lists are merged by a heap; more are merged as sorted runs, with the same result.
HEAPED = 20_000


def shingles(text: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, by row and then hash."""
    docs, hashes = [], []
    for i, _, b, o in chunks(text):
        w = Words(LOWER[b], o)
        h, d = w.hashes()[0], w.doc()
        ok = w.gram_starts(k)
        g, gd = grams(h, k)[ok], d[: len(ok)][ok]
        n = w.counts()
        for x in np.flatnonzero((n > 0) & (n < k)).tolist():  # the whole text is one shingle; its length is hashed with it
            whole = grams(h[w.first[x] : w.first[x + 1]], int(n[x])) + np.uint64(n[x])
            g, gd = np.append(g, whole), np.append(gd, x)
        order = np.lexsort((g, gd))
        g, gd = g[order], gd[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (gd[1:] != gd[:-1])
        docs.append(gd[keep] + i)
        hashes.append(g[keep])
    return np.concatenate(docs) if docs else np.zeros(0, np.int64), np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def _distinct(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct split hashes, whether each occurs more than once, and where each of ``h`` stands among them."""
    keys = B.split(h, ranges)
    distinct, where, n = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, n > 1, where


def _send(k: int, ranges: int):
    def send(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        _, h = shingles(t.column("_text"), k)
        distinct, many, _ = _distinct(h, ranges)
        low = distinct & np.uint64(0xFFFFFFFF)
        rows = [(r, block, B.pack(low[i:j]), B.pack_bits(many[i:j])) for r, i, j in B.by_range(distinct)]
        return pa.table({"range": pa.array([x[0] for x in rows], pa.int64()), "block": pa.array([x[1] for x in rows], pa.int32()), "low": pa.array([x[2] for x in rows], pa.binary()), "many": pa.array([x[3] for x in rows], pa.binary())})

    return send


def _answer(t: pa.Table) -> pa.Table:
    low = [B.unpack(x) for x in t.column("low").to_pylist()]
    packets = [(v, B.unpack_bits(m, len(v))) for v, m in zip(low, t.column("many").to_pylist())]
    return pa.table({"range": t.column("range"), "block": t.column("block"), "level": pa.array([x.tobytes() for x in B.levels_in_range(packets)], pa.binary())})


def _survivors(k: int, ranges: int, percent: int, kind: pa.DataType):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("_id")
        n = docs.num_rows
        row, h = shingles(docs.column("_text"), k) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        distinct, _, where = _distinct(h, ranges)
        data = dict(zip(answers.column("range").to_pylist(), answers.column("level").to_pylist()))
        level = np.concatenate([np.frombuffer(data[r], np.uint8) for r, _, _ in B.by_range(distinct)]) if len(distinct) else np.zeros(0, np.uint8)
        level = level[where]
        size = np.bincount(row, minlength=n)
        shared = np.bincount(row[level > 0], minlength=n) if len(h) else np.zeros(n, int)
        alive = (size > 0) & (100 * shared >= percent * size)
        first = np.concatenate([[0], np.cumsum(size)])
        signature, sets, prefixes, seen = [], [], [], set()
        for d in range(n):
            if not alive[d]:
                signature.append(None)
                sets.append(None)
                prefixes.append(None)
                continue
            own = h[first[d] : first[d + 1]]
            data = own.tobytes()
            s = hashlib.sha256(data).digest()[:16]
            signature.append(s)
            sets.append(None if s in seen else data)  # a block keeps a set once, with the least of its ids
            prefixes.append(None if s in seen else prefix(own, level[first[d] : first[d + 1]], percent).tobytes())
            seen.add(s)
        return pa.table({"_id": docs.column("_id"), "block": docs.column("block"), "n": pa.array(size, pa.int64()), "signature": pa.array(signature, pa.binary()), "prefix": pa.array(prefixes, pa.binary()), "hashes": pa.array(sets, pa.binary())})

    return run


def prefix(h: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order of all: the rarer first, then by hash. Linked sets share one of these."""
    n = len(h)
    return h[np.lexsort((h, level))[: n - (percent * n + 99) // 100 + 1]]


def _prefixes(percent: int):
    """Keys of classes: a shingle of the prefix within a band of set sizes. Linked sets are of one band or of adjacent ones,
    so a class goes to its own and to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x) // 8 for x in batch.column(1).to_pylist()]
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            size = np.maximum(1, batch.column(2).to_numpy())
            band = np.floor(np.log(size) / math.log(100 / percent)).astype(np.uint64) if percent < 100 else size.astype(np.uint64)
            keys = [(h ^ mix(np.repeat(band + np.uint64(k), n))).view(np.int64) for k in range(2)]
            node = batch.column(0).take(pa.array(np.tile(np.repeat(np.arange(len(n)), n), 2)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), node], names=["h", "node"])

    return run


def _shares(items: int, percent: int):
    """Parts of a large cluster: sizes of sets in order, filled up to ``items``; a size beyond that has several. With each size
    goes the run of parts in which sets are that may link with one of that size."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("n", ignore_index=True)
        base, subs, part, filled = [], [], 0, 0
        for x in t["items"].tolist():
            if filled and filled + x > items:
                part, filled = part + 1, 0
            base.append(part)
            subs.append(max(1, -(-x // items)))
            filled += x
            if x > items:
                part, filled = part + subs[-1], 0
        n = t["n"].to_numpy()
        base, subs = np.array(base, np.int32), np.array(subs, np.int32)
        first = base[np.searchsorted(n, -(-percent * n // 100))]
        last = np.searchsorted(n, 100 * n // percent, "right") - 1
        return pd.DataFrame({"label": t["label"], "n": n, "base": base, "subs": subs, "first": first, "last": base[last] + subs[last] - 1})

    return run


class Index:
    """Inverted lists of the sets of one block of a cluster."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((doc, every))
        self.doc = doc[order]
        every = every[order]
        at = B.runs(every)
        self.token, self.start = every[at], np.append(at, len(every))
        self.posting = np.repeat(np.arange(len(at)), np.diff(self.start)) * len(sets) + self.doc  # ascending

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """The sets with 100 |both| >= percent |either|, by T-occurrence with DivideSkip."""
        q = len(query)
        where = np.searchsorted(self.token, query)
        found = where < len(self.token)
        found[found] = self.token[where[found]] == query[found]
        where = where[found]
        least = (percent * q + 99) // 100  # an overlap below this share of the query itself never suffices
        if len(where) < least:
            return np.zeros(0, np.int64)
        length = self.start[where + 1] - self.start[where]
        where = where[np.argsort(length, kind="stable")]
        long = min(least - 1, int(least / (MU * math.log2(max(1, int(length.max()))) + 1)))
        candidates, both = self._merge(where[: len(where) - long], least - long)
        need = -(-percent * (q + self.size[candidates]) // (100 + percent))
        go = (both + long >= need) & (self.size[candidates] >= need)
        candidates, both, need = candidates[go], both[go], need[go]
        if long and len(candidates):  # binary probes of the long lists
            wanted = where[len(where) - long :, None] * len(self.size) + candidates
            at = np.minimum(np.searchsorted(self.posting, wanted.ravel()), len(self.posting) - 1)
            both = both + (self.posting[at] == wanted.ravel()).reshape(wanted.shape).sum(0)
        return candidates[both >= need]

    def _merge(self, where: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets that stand in at least ``least`` of these lists, in order, and in how many."""
        lists = [self.doc[a:b] for a, b in zip(self.start[where].tolist(), self.start[where + 1].tolist())]
        if sum(map(len, lists)) <= HEAPED:
            found = heap_merge([x.tolist() for x in lists], least)
            return np.array([d for d, _ in found], np.int64), np.array([n for _, n in found], np.int64)
        every = np.sort(np.concatenate(lists).astype(np.min_scalar_type(len(self.size))), kind="stable")  # merges sorted runs
        at = B.runs(every)
        n = np.diff(np.append(at, len(every)))
        return every[at[n >= least]].astype(np.int64), n[n >= least]


def heap_merge(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, how many lists have it) of the values in at least ``least`` of the sorted lists, skipping ahead where none can be."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out.append((top, len(popped)))
            ahead = top + 1
        else:  # with so few more lists gone, only what the next one begins with can be in enough
            popped += [heapq.heappop(heap) for _ in range(min(len(heap), least - 1 - len(popped)))]
            if not heap:
                break
            ahead = heap[0][0]
        for _, i, at in popped:
            x = lists[i]
            at = at + 1 if ahead == top + 1 and x[at] == top else bisect_left(x, ahead, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    return out


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _search(percent: int):
    """Searches one block of a cluster against another: links, by class size, and one chain of links a group."""

    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        many, part = (np.array(t.column(c).to_pylist(), np.int64) for c in ("many", "part"))
        node = t.column("node").combine_chunks()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        index = Index([sets[x] for x in right])
        links = np.zeros(len(sets), np.int64)
        parent = list(range(len(sets)))
        for x in left.tolist():
            hits = right[index.search(sets[x], percent)]
            hits = hits[hits != x]
            links[x] += many[hits].sum()
            if i != j:
                links[hits] += many[x]
            for y in hits.tolist():
                a, b = _find(parent, x), _find(parent, y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        root = [_find(parent, x) for x in range(len(sets))]
        return pa.table({"node": node, "links": pa.array(links), "root": node.take(pa.array(root, pa.int64()))})

    return run


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, k: int = K) -> DataFrame:
    """One row for each row of ``df``: id, ``n_shingles``, ``n_similar`` and ``component_id``.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct ``k``-word shingles, or the whole
    sequence of a text of fewer words. Two rows link when 100 |both| >= ``percent`` |either|; ``n_similar`` counts the
    other rows linked directly, ``component_id`` is the least id reachable. Null and empty texts have no shingles, link
    with nothing and stand for themselves. Rows that repeat an id are rows of their own, linked when their texts are.
    Rows with a null id link with nothing and have a null component. An empty table gives an empty result.
    """
    base = df.select(F.col(f"`{id}`").cast("bigint").alias("_id"), F.when(F.col(f"`{id}`").isNotNull(), F.col(f"`{text}`").cast("string")).alias("_text"), F.col(f"`{text}`").cast("string").alias("_any"))
    count, ranges = B.layout(base, "_text")
    nameless = base.where("_id is null").select("_id", "_any")
    base = base.where("_id is not null").select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    base = base.withColumn("block", B.block_of(F.xxhash64("_id", "_text"), count))
    sent = base.groupBy("block").applyInArrow(_send(k, ranges), "range bigint, block int, low binary, many binary")
    answers = sent.groupBy("range").applyInArrow(_answer, "range bigint, block int, level binary")
    survivors = _survivors(k, ranges, percent, pa.int64())
    docs = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(survivors, "_id bigint, block int, n bigint, signature binary, prefix binary, hashes binary")
    docs = table(docs, "shingled")
    # the document of the least id that has its class's set with it stands for the class; sets themselves aren't shuffled
    place = F.struct("_id", "block")
    classes = docs.where("signature is not null").groupBy(F.col("signature").alias("node")).agg(
        F.min("_id").alias("least"),
        F.min(F.when(F.col("hashes").isNotNull(), place)).alias("holder"),
        F.count("*").alias("many"),
    )
    classes = table(classes, "classes")
    held = lambda t: (docs["signature"] == t["node"]) & (docs["_id"] == t["holder"]["_id"]) & (docs["block"] == t["holder"]["block"])
    keys = docs.where("prefix is not null").join(classes, held(classes)).select("node", "prefix", "n").mapInArrow(_prefixes(percent), "h bigint, node binary")
    keys = table(keys, "prefixes")
    hubs = keys.groupBy("h").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    edges = join_entries(keys, hubs, "h", F.col("c"), keys.count()).where("hub is not null and node <> hub")
    edges = edges.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(edges).select(F.col("node").alias("node2"), "label")
    chosen = table(classes.join(clusters, F.col("node") == F.col("node2")).select("node", "holder", "many", "label"), "chosen")
    members = docs.where("hashes is not null").join(chosen, held(chosen)).select("node", "many", "hashes", "label", "n")
    members = table(members, "members")
    tasks_wanted = math.ceil((members.agg(F.sum("n")).first()[0] or 0) / CLUSTER_ITEMS * 4) + 1
    sizes = members.groupBy("label", "n").agg(F.sum("n").alias("items"))
    large = table(sizes.groupBy("label").agg(F.sum("items").alias("all")).where(F.col("all") > CLUSTER_ITEMS).select("label"), "large")
    one = F.lit(0)
    if large.isEmpty():
        split = members.withColumns({"part": one, "first": one, "last": one})
    else:
        shares = sizes.join(large, "label").groupBy("label").applyInPandas(_shares(CLUSTER_ITEMS, percent), "label binary, n bigint, base int, subs int, first int, last int")
        split = members.join(table(shares, "shares"), ["label", "n"], "left")
        part = F.col("base") + F.pmod(F.xxhash64("node"), F.col("subs")).cast("int")
        split = split.withColumns({"part": F.coalesce(part, one), "first": F.coalesce("first", one), "last": F.coalesce("last", one)}).drop("base", "subs")
    other = F.explode(F.sequence("first", "last")).alias("other")
    tasks = split.select("*", other).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    tasks = tasks.repartition(tasks_wanted, "label", "i", "j")  # few bytes, but work: not to be coalesced
    found = table(tasks.groupBy("label", "i", "j").applyInArrow(_search(percent), "node binary, links bigint, root binary"), "links")
    links = found.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    linked = components(found.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    linked = linked.select(F.col("node").alias("c_node"), F.col("label").alias("c_label"))
    info = classes.join(links, F.col("node") == F.col("l_node"), "left").join(linked, F.col("node") == F.col("c_node"), "left")
    info = table(info.select("node", "least", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("c_label", "node").alias("group"), "many"), "info")
    least = info.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("component"))
    info = info.join(least, F.col("group") == F.col("g")).select(F.col("node").alias("signature"), "n_similar", "component", "many")
    out = join_entries(docs.select("_id", "n", "signature"), info, "signature", F.col("many"), docs.count())
    out = out.select(F.col("_id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("bigint").alias("n_similar"), F.coalesce("component", "_id").alias("component_id"))
    alone = nameless.mapInArrow(_count_only(k), "_id bigint, n bigint")
    alone = alone.select(F.col("_id").alias(id), F.col("n").alias("n_shingles"), F.lit(0).cast("bigint").alias("n_similar"), F.lit(None).cast("bigint").alias("component_id"))
    return out.unionByName(alone)


def _count_only(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _ = shingles(batch.column(1), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64())], names=["_id", "n"])

    return run
