"""Byte-pair encoding and decoding with a public vocabulary file, exactly as the tokenizers library does.

Method: a contiguous rank array. A word is held as its parts and the merge ranks of adjacent parts, side by side; the
array is scanned for the least rank, that boundary is deleted, and the two neighbouring ranks are refreshed, until no
pair has a rank. Words of equal length are rows of one matrix, so a scan serves thousands of words at once; words
beyond ``SHORT`` bytes go through a heap over a linked list, which yields the same parts in O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 64
NONE = np.int32(2**31 - 1)
CACHED = 150_000
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that Unicode 16 added with letters or numbers; Python's own tables may be older, the regex library's newer.
UNICODE_16: tuple[tuple[int, int], ...] = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CE), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x16EA0, 0x16EB8), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
#: Capitals that Unicode 16 and 17 added, and their small letters.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
NEW_CAPITAL = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")
LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
LATIN_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
CLITIC = "'s|'t|'re|'ve|'m|'ll|'d"
PIECE_LATIN = re.compile(rf"{CLITIC}|[{LATIN}]+|[{LATIN_NUMBER}]|[^{SPACE}{LATIN}{LATIN_NUMBER}]+")
BEYOND_LATIN = re.compile(r"[^\x00-\u017f]")
SPACES = re.compile(f"[{SPACE}]+")


def category_ranges(first: str) -> str:
    """A character class of all code points whose general category starts so."""
    inside = [unicodedata.category(chr(i))[0] == first for i in range(0x110000)]
    for m in regex.finditer(rf"\p{{{first}}}", "".join(chr(i) for a, b in UNICODE_16 for i in range(a, b + 1))):
        inside[ord(m[0])] = True
    edges = [i for i in range(0x110001) if (i < 0x110000 and inside[i]) != (i > 0 and inside[i - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2]))


@lru_cache(1)
def piece_pattern() -> re.Pattern:
    letters, numbers = category_ranges("L"), category_ranges("N")
    return re.compile(rf"{CLITIC}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairTable:
    """Ranks of pairs of ids, in a few open tables; a pair that collides moves to the next."""

    BITS = 19

    def __init__(self, pairs: np.ndarray):
        self.levels = []
        keys, ranks = pairs.astype(np.uint64), np.arange(len(pairs), dtype=np.int32)
        while len(keys):
            slot = self._slot(keys, len(self.levels))
            table_keys = np.full(1 << self.BITS, np.uint64(2**64 - 1))
            table_ranks = np.full(1 << self.BITS, NONE, np.int32)
            _, first = np.unique(slot, return_index=True)
            table_keys[slot[first]], table_ranks[slot[first]] = keys[first], ranks[first]
            self.levels.append((table_keys, table_ranks))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks = keys[left], ranks[left]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return (keys * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[level])) >> np.uint64(64 - self.BITS)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(keys.shape, NONE, np.int32)
        for level, (table_keys, table_ranks) in enumerate(self.levels):
            slot = self._slot(keys, level)
            hit = table_keys[slot] == keys
            out[hit] = table_ranks[slot[hit]]
        return out


class Codec:
    """Encodes texts to ids and joins ids to text by one vocabulary file of the tokenizers library's BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in (vocab | self.special).items():
            self.token[i] = t
        self.number = [str(i) for i in range(len(self.token))]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.pairs = PairTable((left << np.uint64(32)) | right)
        self.by_pair = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right))}
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        """Normalised pieces: NFC, white space as one space, each character in lower case by itself."""
        if BEYOND_LATIN.search(text):
            text = SPACES.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
            if NEW_CAPITAL.search(text):
                text = text.translate(CAPITALS)
            return piece_pattern().findall("".join(map(str.lower, text)) if "σ" in text else text.lower())
        return PIECE_LATIN.findall(text.lower())

    def encode_short(self, words: np.ndarray) -> list[np.ndarray]:
        """``words``: a matrix of bytes, a word in each row. The ids of each row."""
        n, m = words.shape
        ids = self.inner[words]
        ids[:, -1] = self.final[words[:, -1]]
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        row = np.arange(n)
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            if m == 1:
                for r, x in zip(row.tolist(), ids):
                    out[r] = x
                break
            at = ranks.argmin(1)
            here = np.arange(len(row))
            least = ranks[here, at]
            done = least == NONE
            if done.any():
                for r, x in zip(row[done].tolist(), ids[done]):
                    out[r] = x
                go = ~done
                row, ids, ranks, at, least = row[go], ids[go], ranks[go], at[go], least[go]
                if not len(row):
                    break
                here = np.arange(len(row))
            ids[here, at] = self.merged[least]
            keep = np.arange(m) != (at + 1)[:, None]
            ids = ids[keep].reshape(len(row), m - 1)
            keep = np.arange(m - 1) != at[:, None]
            ranks = ranks[keep].reshape(len(row), m - 2)
            m -= 1
            before = at > 0
            ranks[here[before], at[before] - 1] = self.pairs.ranks(ids[here[before], at[before] - 1], ids[here[before], at[before]])
            after = at < m - 1
            ranks[here[after], at[after]] = self.pairs.ranks(ids[here[after], at[after]], ids[here[after], at[after] + 1])
        return out

    def encode_long(self, word: bytes) -> list[int]:
        """One long word by a heap of (rank, place) over a linked list."""
        b = np.frombuffer(word, np.uint8)
        ids = self.inner[b]
        ids[-1] = self.final[b[-1]]
        ids = ids.tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.by_pair.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b_ = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b_:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (x := rank((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (x := rank((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces not met before in the cache."""
        if len(self.ids) > CACHED:
            self.ids.clear()
            self.texts.clear()
        new = [p for p in pieces if p not in self.ids]
        by_length: dict[int, list[int]] = {}
        raw = [p.encode() for p in new]
        for i, w in enumerate(raw):
            by_length.setdefault(len(w), []).append(i)
        for n, which in by_length.items():
            if n > SHORT:
                found = (self.encode_long(raw[i]) for i in which)
            else:
                found = (x.tolist() for x in self.encode_short(np.frombuffer(b"".join([raw[i] for i in which]), np.uint8).reshape(-1, n)))
            for i, ids in zip(which, found):
                self.ids[new[i]] = " ".join([self.number[x] for x in ids])
                self.texts[new[i]] = " ".join([self.token[x] for x in ids])

    def parts(self, text: str) -> list[str]:
        """Pieces of a text; the strings of special tokens stand for themselves."""
        if self.special_split and "<|" in text:
            out = []
            for x in self.special_split.split(text):
                if x in self.special:
                    self.ids[x], self.texts[x] = self.number[self.special[x]], x
                    out.append(x)
                else:
                    out += self.split(x)
            return out
        return self.split(text)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Of each text its decimal ids joined by spaces, and the text they decode to."""
        all_parts = [self.parts(t) if t else [] for t in texts]
        self.learn({p for parts in all_parts for p in parts} - self.special.keys())
        for parts in all_parts if self.special else ():
            for s in self.special.keys() & set(parts) if len(parts) else ():
                self.ids[s], self.texts[s] = self.number[self.special[s]], s
        ids, decoded = self.ids.__getitem__, self.texts.__getitem__
        return [(" ".join(map(ids, parts)), " ".join(map(decoded, parts))) for parts in all_parts]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: token strings joined by spaces. Unknown ids are left out."""
        return " ".join([self.token[i] for i in ids if 0 <= i < len(self.token)])


def _runs(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    i = n = 0
    for j, t in enumerate(texts):
        n += len(t or "")
        if n >= limit:
            yield i, j + 1
            i, n = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def encode(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """Ids and decoded text of every row of ``df``, beside its ``keys``.

    Returns the keys, ``n_tokens``, and ``ids`` (array) and ``decoded``, or with ``digest`` their SHA-256 digests
    ``ids_sha256`` (of the decimal ids joined by one space) and ``decoded_sha256``. Rows correspond one to one: a null
    or empty text has no tokens, repeated rows give repeated results, an empty table an empty one; keys may be null.
    No shuffle: texts stay in their partitions.
    """
    fields = [df.schema[k] for k in keys]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = f"{head}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for i, j in _runs(texts):
                found = codec.encode_batch(texts[i:j])
                n = pa.array([x.count(" ") + 1 if x else 0 for x, _ in found], pa.int64())
                if digest:
                    made = [pa.array([hashlib.sha256(x[k].encode()).hexdigest() for x in found]) for k in (0, 1)]
                else:
                    made = [pa.array([[int(y) for y in x.split()] for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keys))), n, *made], names=[*keys, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])

    return df.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)
