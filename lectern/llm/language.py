"""Language identification by prediction by partial matching.

For each language a byte context tree of order ``ORDER`` holds how often each symbol followed each context in the
training texts. A symbol seen in a context costs its share of the context's count, with one escape for each distinct
symbol (method C); otherwise the escape, and its cost in the next shorter context, down to even odds. The trees are
frozen after training and unrolled: the exact code length of every symbol after every context that any tree knows is
one row of a table, so that scoring a text is one lookup a byte for all languages at once. Where that table would be
too large (many languages), each language keeps the symbols it saw after each context instead, and the distinct grams
of a run of texts are looked up language by language; the code lengths are the same. The language of the least code
length wins.

Texts are lower-cased; ASCII other than letters is one symbol, every other byte stands for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textbytes import chunks

ORDER = 3
#: Training rows a language, at most about (rows are chosen by a hash of their id), and bytes a row may have to be one.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 1 << 16
#: Cells of the unrolled table, beyond which there is none.
CELLS = 12_000_000
SCORED = 1 << 19


class Trees:
    """Frozen context trees of several languages, unrolled."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        seen = np.zeros(256, bool)
        for t in texts.values():
            for x in t:
                seen[np.frombuffer(x, np.uint8)] = True
        own = [b for b in range(256) if 97 <= b <= 122 or b >= 128 and seen[b]]
        self.map = np.zeros(256, np.uint8)
        self.map[128:] = len(own) + 1  # bytes never met
        self.map[own] = np.arange(1, len(own) + 1)
        self.letters = np.zeros(256, bool)
        self.letters[97:123] = True
        a = self.symbols = len(own) + 2
        grams = {lang: self._count(t) for lang, t in texts.items()}
        contexts = [np.unique(np.concatenate([g[k][0] // a for g in grams.values()])) if grams else np.zeros(0, np.int64) for k in range(ORDER + 1)]
        self.sparse = [[self._sparse(x) for x in g] for g in grams.values()] if (1 + sum(map(len, contexts[1:]))) * a * len(texts) > CELLS else None
        if self.sparse is not None:
            return
        # rows: the empty context, then those of order 1, 2 and so on; each context's row starts as its suffix's
        rows = [np.zeros(1, np.int64)]
        table = [np.full((1, a, len(texts)), -np.log2(1 / a), np.float32)]
        for lang, g in enumerate(grams.values()):
            table[0][:, :, lang] = self._costs(g[0], rows[0], a, np.full((1, a), np.log2(a)))
        for k in range(1, ORDER + 1):
            suffix = np.searchsorted(rows[-1], contexts[k] % a ** (k - 1))
            suffix = np.minimum(suffix, len(rows[-1]) - 1)
            known = rows[-1][suffix] == contexts[k] % a ** (k - 1)
            contexts[k], suffix = contexts[k][known], suffix[known]
            t = np.empty((len(contexts[k]), a, len(texts)), np.float32)
            for lang, g in enumerate(grams.values()):
                t[:, :, lang] = self._costs(g[k], contexts[k], a, table[-1][suffix, :, lang])
            rows.append(contexts[k])
            table.append(t)
        start = np.cumsum([0, *map(len, rows)])
        self.cost = np.concatenate([t.reshape(-1, len(texts)) for t in table]) if texts else np.zeros((a, 0), np.float32)
        self.row = np.zeros(a**ORDER, np.int32)  # of each context of full order, the row of its longest known suffix
        every = np.arange(a**ORDER)
        for k in range(1, ORDER + 1):
            short = every % a**k
            at = np.minimum(np.searchsorted(rows[k], short), max(0, len(rows[k]) - 1))
            if len(rows[k]):
                hit = rows[k][at] == short
                self.row[hit] = start[k] + at[hit]

    def _count(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the distinct grams, context and symbol as one number, and their counts."""
        out = []
        runs = [self.map[np.frombuffer(x, np.uint8)].astype(np.int64) for x in texts]
        for k in range(ORDER + 1):
            parts = []
            for s in runs:
                padded = np.concatenate([np.zeros(k, np.int64), s])
                g = np.zeros(len(s), np.int64)
                for i in range(k + 1):
                    g = g * self.symbols + padded[i : i + len(s)]
                parts.append(g)
            out.append(np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True))
        return out

    def _sparse(self, grams: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Grams of one order and their bits, contexts and the bits of their escapes."""
        contexts, at = np.unique(grams[0] // self.symbols, return_inverse=True)
        total, kinds = np.bincount(at, grams[1], len(contexts)), np.bincount(at, minlength=len(contexts))
        return grams[0], np.log2((total + kinds)[at] / grams[1]).astype(np.float32), contexts, np.log2((total + kinds) / np.maximum(kinds, 1)).astype(np.float32)

    def _bits(self, tree: list, grams: np.ndarray) -> np.ndarray:
        """Bits of grams of full order under one language's sparse tree."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, -1, -1):
            known, bits, contexts, escape = tree[k]
            if not len(known):
                continue
            g = grams[open_] % self.symbols ** (k + 1)
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = known[at] == g
            out[open_[hit]] += bits[at[hit]]
            open_, g = open_[~hit], g[~hit] // self.symbols
            at = np.minimum(np.searchsorted(contexts, g), len(contexts) - 1)
            out[open_] += np.where(contexts[at] == g, escape[at], 0)
        out[open_] += np.log2(self.symbols)
        return out

    @staticmethod
    def _costs(grams: tuple[np.ndarray, np.ndarray], contexts: np.ndarray, a: int, shorter: np.ndarray) -> np.ndarray:
        """Bits of each symbol after each context; ``shorter`` has the bits after the next shorter one."""
        at = np.searchsorted(contexts, grams[0] // a)
        at = np.minimum(at, len(contexts) - 1)
        known = contexts[at] == grams[0] // a if len(contexts) else np.zeros(len(at), bool)
        at, symbol, n = at[known], grams[0][known] % a, grams[1][known]
        total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
        escape = np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1))
        out = shorter + escape[:, None]
        out[at, symbol] = np.log2((total + kinds)[at] / n)
        return out

    def code_lengths(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (lower-cased) under each language."""
        a, n = self.symbols, len(offsets) - 1
        s = self.map[b].astype(np.int32)
        out = np.zeros((n, len(self.languages)))
        context = np.zeros(len(b), np.int32)
        place = np.arange(len(b), dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.int32)
        for back in range(1, ORDER + 1):
            x = s[:-back] * np.int32(a ** (back - 1)) if back < len(s) else s[:0]
            context[back:] += np.where(place[back:] >= back, x, 0)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if self.sparse is not None:
            grams, at = np.unique(context.astype(np.int64) * a + s, return_inverse=True)
            for lang, tree in enumerate(self.sparse):
                if len(filled):
                    out[filled, lang] = np.add.reduceat(self._bits(tree, grams)[at], offsets[filled])
            return out
        for i in range(0, len(b), SCORED):
            j = min(len(b), i + SCORED)
            cost = self.cost[self.row[context[i:j]] * a + s[i:j]]
            inside = filled[(offsets[filled] < j) & (offsets[filled + 1] > i)]
            out[inside] += np.add.reduceat(cost, np.maximum(offsets[inside] - i, 0), axis=0)
        return out


def training(df: DataFrame, id: str, text: str, lang: str) -> DataFrame:
    """Rows to learn from: their language and text; remainder 2 of the id's CRC-32 by 4 is held out."""
    return df.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & (F.crc32(F.col(f"`{id}`").cast("string")) % 4 != 2)).select(F.xxhash64(F.col(f"`{id}`").cast("string"), F.lit(3)).alias("h"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))


def learn(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Trees:
    """Trees of all languages. The driver gets at most about SAMPLE_ROWS rows of each.

    A language of fewer short rows is learned from longer ones too, by their first SAMPLE_BYTES characters.
    """
    rows = training(df, id, text, lang).withColumn("long", F.octet_length("text") > SAMPLE_BYTES).withColumn("text", F.substring("text", 1, SAMPLE_BYTES))
    counts = {(r["lang"], r["long"]): r["count"] for r in rows.groupBy("lang", "long").count().collect()}
    if not counts:
        return Trees({})
    wanted = {(k, long): SAMPLE_ROWS - (counts.get((k, False), 0) if long else 0) for k, long in counts}
    limits = df.sparkSession.createDataFrame([(k, long, min(1.0, max(0, wanted[k, long]) / n)) for (k, long), n in sorted(counts.items())], "lang string, long boolean, most double")
    share = (F.pmod(F.col("h"), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    texts: dict[str, list[str]] = {}
    for r in rows.join(F.broadcast(limits), ["lang", "long"]).where(share < F.col("most")).select("lang", "text", "h").orderBy("lang", "h", "text").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    # lower-cased as texts to predict are, by the same tables
    return Trees({lang: [x.encode() for x in pc.utf8_lower(pa.array(found, pa.large_string())).to_pylist()] for lang, found in texts.items()})


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row of ``df``: id, ``held_out``, ``lang_pred``, ``score`` (0 to 1) and ``bits`` a byte.

    Learns from the rows of ``training``; predicts every row from its text alone. ``lang_pred`` is a learned language,
    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned. Equal code lengths go to
    the first language by code point. ``score`` is the language's share of probability among those learned. A null id is
    not held out and not learned from. Repeated rows repeat their result; an empty table gives an empty result.
    """
    spark = df.sparkSession
    trees = learn(df, id, text, lang)
    sent = spark.sparkContext.broadcast(trees)  # at most CELLS numbers and the context index, or the grams of each language
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        names = np.array([*trees.languages, "und"], object)
        for batch in batches:
            column = pc.utf8_lower(batch.column(2))
            for i, j, b, o in chunks(column):
                n = j - i
                ascii_letters = np.zeros(len(b) + 1, np.int64)
                np.cumsum(trees.letters[b], out=ascii_letters[1:])
                letter = np.diff(ascii_letters[o]) > 0
                for k in np.flatnonzero(~letter & (np.diff(o) > 0)).tolist():
                    letter[k] = has_letter(column[i + k].as_py())
                if trees.languages:
                    bits = trees.code_lengths(b, o)
                    best = bits.argmin(1)
                    share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                    rate = bits.min(1) / np.maximum(np.diff(o), 1)
                else:
                    letter[:] = False
                    best, share, rate = np.zeros(n, int), np.zeros(n), np.zeros(n)
                pred = names[np.where(letter, best, len(trees.languages))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(pred.tolist(), pa.string()), pa.array(np.where(letter, share, 0.0)), pa.array(np.where(letter, rate, 0.0))], names=["_id", "held_out", "lang_pred", "score", "bits"])

    held = F.coalesce(F.crc32(F.col(f"`{id}`").cast("string")) % 4 == 2, F.lit(False))
    return df.select(F.col(f"`{id}`"), held.alias("_held"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"_id {kind}, held_out boolean, lang_pred string, score double, bits double").withColumnRenamed("_id", id)
