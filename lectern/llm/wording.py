"""Evidence by wording: a sparse logistic model on the words and beginnings of words of a text.

Of all words and word beginnings (``PREFIXES`` bytes) of the labelled sample, those stay that stand in rows labelled 1
more often than chance allows: by Chernoff's bound on the binomial tail, over all that were tried. How often each
stands in a text, and for how much of its words, are the features of a ridge-penalised logistic model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import table
from lectern.llm.textbytes import FEATURE, Words, chunks

PREFIXES = (3, 4, 5, 6, 7, 8)
#: Rows a word must stand in to be tried, and the chance that any of those kept is there by luck.
LEAST_ROWS, CHANCE = 5, 0.05
#: Marks whole words apart from beginnings.
WHOLE = np.uint64(0x5851F42D4C957F2D)

#: Letters as they are (texts come lower-cased), all other ASCII a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def letters(b: np.ndarray) -> np.ndarray:
    """Bytes with all but letters as spaces; also the punctuation of U+00A0-00BF and U+2000-207F."""
    out = FOLD[b]
    at = np.flatnonzero((b[:-1] == 0xC2) & (b[1:] < 0xC0)) if len(b) else np.zeros(0, np.int64)
    out[at] = out[at + 1] = 32
    at = np.flatnonzero((b[:-2] == 0xE2) & ((b[1:-1] == 0x80) | (b[1:-1] == 0x81))) if len(b) > 2 else np.zeros(0, np.int64)
    out[at] = out[at + 1] = out[at + 2] = 32
    return out


def parts(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its words' and beginnings' row and hash, unsorted, and the number of words of each row."""
    b = letters(b)
    w = Words(b, o)
    doc, size = w.doc(), w.end - w.start
    longer = [size > k for k in PREFIXES]
    start = np.concatenate([w.start, *(w.start[x] for x in longer)])
    end = np.concatenate([w.end, *(w.start[x] + k for x, k in zip(longer, PREFIXES))])
    h = FEATURE.spans(b, start, end)
    h[: len(w.start)] ^= WHOLE
    return np.concatenate([doc, *(doc[x] for x in longer)]), h, w.counts()


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows, and how many of them labelled 1, each word or beginning stands in."""
    for batch in batches:
        y = batch.column(1).to_numpy()
        for i, _, b, o in chunks(pc.utf8_lower(batch.column(0))):
            doc, h, _ = parts(b, o)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)  # once a row
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h = doc[new], h[new]
            kinds, at = np.unique(h, return_inverse=True)
            ones = np.bincount(at, y[i + doc], len(kinds)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(at, minlength=len(kinds))), pa.array(ones)], names=["h", "n", "ones"])


class Wording:
    """Weights of words and beginnings, by sorted hash: of the logarithm of the count, and of the root of the share."""

    def __init__(self, kinds: np.ndarray, weights: np.ndarray, constant: float, learned: bool = True):
        self.kinds, self.weights, self.constant, self.learned = kinds, weights, constant, learned
        self.maybe = np.zeros(1 << 16, bool)  # by low bits: most hashes end here
        self.maybe[kinds & np.uint64(0xFFFF)] = True

    @classmethod
    def none(cls) -> Wording:
        """What gives every text even odds."""
        return cls(np.zeros(0, np.uint64), np.zeros(0), 0.0, False)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and where."""
        some = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.kinds, h[some]), max(0, len(self.kinds) - 1))
        hit = self.kinds[at] == h[some] if len(self.kinds) else np.zeros(0, bool)
        return some[hit], at[hit]

    def features(self, doc: np.ndarray, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value, without zeros."""
        some, at = self.find(h)
        key, n = np.unique(doc[some] * max(1, len(self.kinds)) + at, return_counts=True)
        row, k = np.divmod(key, max(1, len(self.kinds)))
        return np.concatenate([row, row]), np.concatenate([k, k + len(self.kinds)]), np.concatenate([np.log1p(n), np.sqrt(n / (words[row] + 20.0)) * 4])

    def evidence(self, b: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Log odds of 1 of each text, lower-cased."""
        if not len(self.kinds):
            return np.full(len(o) - 1, self.constant)
        row, k, v = self.features(*parts(b, o))
        return self.constant + np.bincount(row, v * self.weights[k], len(o) - 1)


def fit(row: np.ndarray, k: np.ndarray, v: np.ndarray, y: np.ndarray, size: int, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a logistic model on sparse values, the last one its constant, by Newton's steps with conjugate gradients."""
    n = len(y)
    row, k, v = np.concatenate([row, np.arange(n)]), np.concatenate([k, np.full(n, size)]), np.concatenate([v, np.ones(n)])
    keep = np.append(np.full(size, ridge), 1e-3)
    ahead = lambda w: np.bincount(row, v * w[k], n)
    back = lambda r: np.bincount(k, v * r[row], size + 1)
    loss = lambda w, z: np.logaddexp(0, z).sum() - y @ z + 0.5 * keep @ (w * w)
    w = np.zeros(size + 1)
    z = ahead(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        r = back(y - p) - keep * w
        curve = p * (1 - p)
        scale = np.bincount(k, v * v * curve[row], size + 1) + keep
        step, q = np.zeros(size + 1), r / scale
        d, e0 = q.copy(), r @ q
        e = e0
        for _ in range(100):
            if e <= 1e-10 * e0 or e <= 0:
                break
            hd = back(curve * ahead(d)) + keep * d
            a = e / (d @ hd)
            step += a * d
            r = r - a * hd
            q = r / scale
            e, old = r @ q, e
            d = q + e / old * d
        was, size_of = loss(w, z), 1.0
        dz = ahead(step)
        while size_of > 1e-6 and loss(w + size_of * step, z + size_of * dz) > was:
            size_of /= 2
        w, z = w + size_of * step, z + size_of * dz
        if size_of * np.abs(step).max() < 1e-6:
            break
    return w


def learn(sample: DataFrame, ridge: float = 1.0) -> Wording:
    """The model of a bounded ``sample`` with ``text`` and ``y``, 0 or 1. The driver gets the kept words of its rows only."""
    rows = table(sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("double").alias("y")), "wording")
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < ones < n:
        return Wording.none()
    kinds = rows.mapInArrow(_tally, "h bigint, n bigint, ones bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where(F.col("n") >= LEAST_ROWS)
    kinds = table(kinds, "kinds")
    share, p = F.col("ones") / F.col("n"), ones / n
    by_chance = F.col("ones") * F.log(share / p) + F.when(share < 1, (F.col("n") - F.col("ones")) * F.log((1 - share) / (1 - p))).otherwise(0.0)
    kept = kinds.where((share > p) & (by_chance > math.log(max(1, kinds.count()) / CHANCE))).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    model = Wording(np.sort(kept), np.zeros(2 * len(kept)), 0.0)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, o in chunks(pc.utf8_lower(batch.column(0))):
                row, k, v = sent.value.features(*parts(b, o))
                order = np.lexsort((k, row))
                cuts = np.searchsorted(row[order], np.arange(j - i + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(cuts, pa.array(x[order]))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), lists(k), lists(v)], names=["y", "k", "v"])

    # in an order of its own: sums don't depend on that of tasks
    found = rows.mapInArrow(run, "y double, k array<bigint>, v array<double>").orderBy("y", "k", "v").toPandas()
    row = np.repeat(np.arange(len(found)), found["k"].map(len))
    w = fit(row, np.concatenate([np.asarray(x, np.int64) for x in found["k"]]), np.concatenate([np.asarray(x, float) for x in found["v"]]), found["y"].to_numpy(float), 2 * len(kept), ridge)
    return Wording(model.kinds, w[:-1], float(w[-1]))
