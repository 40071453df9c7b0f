"""A document read once, in Python, over Arrow batches: sentences, words, segments and the statistics of both.

The same definitions as the columns of ``text``, whose patterns these are, translated: interpreted expressions over arrays of
tokens took some ten microseconds a character, this takes a fraction of one. Batches are read a few rows at a time and go
back as columns, and of those rows one document's words are held at a time, so the memory of a worker is that of one batch and
one document, whatever the size of the table.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.diversity import WINDOW, window_distinct
from lectern.functions.tables import ADDITIVE, CONNECTORS, FUNCTION_WORDS, PUNCTUATION, TARGETS, TEMPORAL

ROWS = 128  # of a batch, turned into columns at a time


def translated(rx: str) -> str:
    """A pattern of Java's dialect in Python's. Letters and digits are those of Unicode, cases those of ASCII."""
    for a, b in ((r"[^\p{L}\p{N}_]", r"(?u:\W)"), (r"[\p{L}\p{N}_]", r"(?u:\w)"), (r"[\p{L}\p{N}]", r"(?u:[^\W_])"), (r"[\p{L}\p{N}_'’-]", r"(?u:[\w'’-])"), (r"(?<=\n|\A)", r"(?:(?<=\n)|\A)"), (r"\z", r"\Z")):
        rx = rx.replace(a, b)
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), rx)


@lru_cache(None)
def pattern(rx: str) -> re.Pattern:
    return re.compile(translated(rx), re.A)


def _class_of(kinds: str) -> str:
    """A class of all characters of some general categories."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in kinds
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "[" + "".join(out) + "]"


@lru_cache(1)
def words_rx() -> re.Pattern:
    return re.compile(rf"{translated(T._WORD)}|{_class_of('SM')}", re.A)


ASCII_WORDS = re.compile(r"_*+[A-Za-z0-9]\w*+(?:['-]\w++)*+|[$+<=>^`|~]", re.A)
SENTENCE, BY_LINE = pattern(T.SENTENCE), pattern(T.SENTENCE_BY_LINE)
FILLED, ENDED = pattern(rf"[^\n]*[^\n{T.WS}][^\n]*"), pattern(rf"[.!?:;…]{T.CLOSERS}*[ \t\r\f\x0b]*(?=\n|\z)")
CONNECTOR_RANK = {k: i for i, k in enumerate(CONNECTORS)}
BREAK, PARAGRAPH = re.compile(T.SEGMENT_BREAK), re.compile(T.PARAGRAPH_BREAK)
BLANKS = " \t\n\r\f\x0b"
PLAIN = bytes(c for c in range(256) if not chr(c).isalnum() or c > 127)
PLAIN_ = PLAIN.replace(b"_", b"")
TEMPORAL_SET, ADDITIVE_SET, FUNCTION_SET = frozenset(TEMPORAL), frozenset(ADDITIVE), frozenset(FUNCTION_WORDS)


def words(text: str) -> list[str]:
    bare = text.strip(" \n.!?")
    if bare.isascii() and bare.replace(" ", "").isalnum():  # most of them: nothing but words and spaces
        return bare.split()
    return (ASCII_WORDS if text.isascii() else words_rx()).findall(text)


def letters(text: str, of: list[str]) -> int:
    """ASCII letters, digits and underscores inside the words of a text."""
    if "_" in text:
        return sum(len(w.encode("ascii", "ignore").translate(None, PLAIN_)) for w in of)
    return len(text.encode("ascii", "ignore").translate(None, PLAIN))


def grade(n_letters: int, n_words: int, n_sentences: int) -> int:
    if n_words > 0 and n_sentences > 0:
        return max(math.floor(n_letters / n_words * 4.71 + n_words / n_sentences * 0.5 - 21.43 + 0.5), 0)
    return 0


def variation(lengths: list[int]) -> float:
    n, s = float(len(lengths)), float(sum(lengths))
    return math.sqrt(n * float(sum(v * v for v in lengths)) - s * s) / s if n >= 2 and s > 0 else 0.0


class Sentence:
    __slots__ = ("start", "end", "text", "words", "n", "letters", "segments")

    def __init__(self, start: int, end: int, text: str):
        self.start, self.end, self.text = start, end, text
        # no word runs over a break, so the words of the segments are those of the sentence
        parts = [words(p) for p in BREAK.split(text)]
        self.words = [w for p in parts for w in p] if len(parts) > 1 else parts[0]
        self.segments = [len(p) for p in parts if p]
        self.n, self.letters = len(self.words), letters(text, self.words)


class Reading:
    """What the rules and statistics ask of a text, each made when it is first asked for."""

    def __init__(self, text: str | None, target: str = "NORMAL"):
        self.text, self.target = text or "", target

    @cached_property
    def sentences(self) -> list[Sentence]:
        text = self.text
        lines = text.count("\n") >= 4 and sum(1 for _ in FILLED.finditer(text))
        by_line = lines >= 5 and sum(1 for _ in ENDED.finditer(text)) * 5 >= lines * 4
        out, at = [], 0
        for part in (BY_LINE if by_line else SENTENCE).findall(text):
            bare = part.lstrip(BLANKS)
            out.append(Sentence(at + len(part) - len(bare), at + len(part), bare))
            at += len(part)
        return out

    @cached_property
    def some(self) -> list[Sentence]:
        return [s for s in self.sentences if s.n]

    @cached_property
    def lengths(self) -> list[int]:
        return [s.n for s in self.some]

    @cached_property
    def segments(self) -> list[int]:
        return [n for s in self.sentences for n in s.segments]

    @cached_property
    def words(self) -> list[str]:
        return [w for s in self.sentences for w in s.words]

    @cached_property
    def lowered(self) -> list[str]:
        return [w.lower() for w in self.words]

    @cached_property
    def openings(self) -> list[list[str]]:
        return [[w.lower() for w in s.words[:2]] for s in self.some]

    @property
    def connectors(self) -> list[tuple[int, str]]:
        """Of each sentence that opens with connectors the first one, in their order, that its first word or first two are."""
        hits = ((i, [k for k in (o[0], " ".join(o)) if k in CONNECTOR_RANK]) for i, o in enumerate(self.openings))
        return [(i, min(k, key=CONNECTOR_RANK.__getitem__)) for i, k in hits if k]

    @property
    def sums(self) -> list[int]:
        """In the order of ``SUMS``."""
        out: list[int] = []
        for x in (self.lengths, self.segments, [len(p) for p in self.paras]):
            out += (len(x), sum(x), sum(v * v for v in x))
        return [*out, sum(p[-1] <= 8 for p in self.paras), len(self.some), len(self.words), *(self.text.count(m) for m in PUNCTUATION.values())]

    @property
    def n_tokens(self) -> int:
        return len(self.words)

    @property
    def places(self) -> list[tuple[int, str]]:
        """Function words and where they stand."""
        return [(i, w) for i, w in enumerate(self.lowered) if w in FUNCTION_SET]

    @property
    def bigrams(self) -> list[tuple[str, int, int]]:
        """Pairs of adjacent words of letters, not both function words: how often, and where first."""
        out: dict[tuple[str, str], list[int]] = {}
        w = self.lowered
        plain, common = [x.isalpha() for x in w], [x in FUNCTION_SET for x in w]
        for i in range(len(w) - 1):
            if plain[i] and plain[i + 1] and not (common[i] and common[i + 1]):
                if n := out.get(k := (w[i], w[i + 1])):
                    n[0] += 1
                else:
                    out[k] = [1, i]
        return [(f"{a} {b}", n, i) for (a, b), (n, i) in out.items()]

    @property
    def n_sentences(self) -> int:
        return len(self.sentences)

    @cached_property
    def n_words(self) -> int:
        return sum(self.lengths)

    @cached_property
    def n_letters(self) -> int:
        return sum(s.letters for s in self.sentences)

    @cached_property
    def grade(self) -> int:
        return grade(self.n_letters, self.n_words, self.n_sentences)

    @property
    def readability(self) -> str:
        few, hard, very = TARGETS[self.target]
        return "normal" if self.n_words < few or self.grade < hard else "hard" if self.grade < very else "veryHard"

    @cached_property
    def burstiness(self) -> float:
        return variation(self.lengths)

    @cached_property
    def seg_burstiness(self) -> float:
        return variation(self.segments)

    @cached_property
    def alpha(self) -> list[str]:
        return [w.lower() for w in self.words if w.isalpha()]

    @property
    def n_alpha(self) -> int:
        return len(self.alpha)

    @property
    def temporal_ratio(self) -> float:
        t = sum(w in TEMPORAL_SET for w in self.alpha)
        a = sum(w in ADDITIVE_SET for w in self.alpha)
        return t / (t + a) if t + a else 0.0

    @cached_property
    def mattr(self) -> float:
        n, windows, distinct = window_distinct(np.array(self.alpha, object))
        return distinct / float(min(n, WINDOW)) / float(windows) if n else 0.0

    @cached_property
    def paragraphs(self) -> list[tuple[int, int]]:
        out, at = [], 0
        for m in PARAGRAPH.finditer(self.text):
            out.append((at, m.start()))
            at = m.end()
        return [(a, b) for a, b in [*out, (at, len(self.text))] if b > a]

    def by_paragraph(self, least: int) -> list[list[Sentence]]:
        """Of each paragraph the sentences of at least so many words; a sentence is in each one it touches."""
        some = [s for s in self.sentences if s.n >= least]
        starts, ends = [s.start for s in some], [s.end for s in some]
        return [some[bisect_right(ends, a) : bisect_left(starts, b)] for a, b in self.paragraphs]

    @cached_property
    def paras(self) -> list[list[int]]:
        return [[s.n for s in p] for p in self.by_paragraph(1) if p]


#: what can be asked for, and its type
KINDS = {
    "sentences": "array<struct<start:int,end:int,text:string,words:int,letters:int>>", "n_sentences": "int", "n_words": "bigint", "n_letters": "bigint", "grade": "int", "readability": "string", "burstiness": "double", "seg_burstiness": "double",
    "temporal_ratio": "double", "n_alpha": "int", "mattr": "double", "n_tokens": "int", "sums": "array<bigint>", "places": "array<struct<pos:int,word:string>>", "connectors": "array<struct<pos:int,word:string>>", "bigrams": "array<struct<word:string,n:int,pos:int>>", "openings": "array<array<string>>", 
}
#: sizes, sums and squares of sentences, segments and paragraphs, and what else a profile adds up
SUMS = (*(f"{x}_{y}" for x in "lgp" for y in "nsq"), "punchlines", "n_sentences", "n_words", *(f"mark_{k}" for k in PUNCTUATION))
MEASURES = ("n_sentences", "n_words", "n_letters", "grade", "readability", "burstiness", "seg_burstiness")
VOCABULARY = ("temporal_ratio", "n_alpha", "mattr")


_INT, _SENTENCE = pa.int32(), pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("words", pa.int32()), ("letters", pa.int32())])
_ARROW = {"int": _INT, "array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), KINDS["places"]: pa.list_(pa.struct([("pos", _INT), ("word", pa.string())])), KINDS["bigrams"]: pa.list_(pa.struct([("word", pa.string()), ("n", _INT), ("pos", _INT)])), "array<array<string>>": pa.list_(pa.list_(pa.string())), KINDS["sentences"]: pa.list_(_SENTENCE)}


def _arrow(name: str) -> pa.DataType:
    return _ARROW[KINDS[name]]


def asked(r: Reading, names: tuple[str, ...]) -> list:
    """The named values of a reading, without a hold on it: its words go when the next document is read."""
    return [[(s.start, s.end, s.text, s.n, s.letters) for s in r.sentences] if n == "sentences" else getattr(r, n) for n in names]


def columns(names: tuple[str, ...], rows: list[list]) -> list[pa.Array]:
    """What was asked of some documents, a column a name."""
    return [_column(n, [row[i] for row in rows]) for i, n in enumerate(names)]


def _column(name: str, of: list) -> pa.Array:
    if name != "sentences":
        return pa.array(of, _arrow(name))
    kind, flat = _arrow(name), [s for r in of for s in r]
    fields = [pa.array([s[i] for s in flat], kind.value_type.field(i).type) for i in range(5)]
    places = np.concatenate([[0], np.cumsum([len(r) for r in of])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(places), pa.StructArray.from_arrays(fields, fields=[kind.value_type.field(i) for i in range(5)]), type=kind)


def slices(batch, rows: int = ROWS) -> Iterator:
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def told_of(texts: pa.Array, names: tuple[str, ...], target: str) -> pa.Array:
    """The named values of each text as a struct. One document's words are held at a time."""
    fields, parts = [pa.field(n, _arrow(n)) for n in names], []
    for part in slices(texts):
        parts.append(pa.StructArray.from_arrays(columns(names, [asked(Reading(t.as_py(), target), names) for t in part]), fields=fields))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))


def told(text: Column, names: tuple[str, ...], target: str = "NORMAL") -> Column:
    """The named values of a text, as a struct."""
    schema = ",".join(f"{n}:{KINDS[n]}" for n in names)

    @F.arrow_udf(f"struct<{schema}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield told_of(batch, names, target)

    return run(text)
