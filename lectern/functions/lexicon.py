"""Phrases of word lists in texts, with longest-first resolution of overlaps.

Accepting matches by falling length and rising start, each only if it touches no accepted one, depends on order: it is
no anti-join, and no built-in expresses it. It runs over Arrow batches: one automaton finds all phrases of all lists in
one pass over a text; matches must begin and end where tokens do.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.tables import phrases

#: list: its exceptions; a match inside an exception is dropped.
EXCEPTIONS = {"puffery": "puffery_exception", "intensifier": "intensifier_exception", "filler": "filler_exception"}
INFLECTED = ("puffery", "editorializing", "filler", "transition", "intensifier", "praise")
HIT = "array<struct<list:string,phrase:string,start:int,end:int,before:string,after:string>>"
_VOWELS = "aeiou"
NOT_SPACE = re.compile(r"\S")


def inflections(word: str) -> set[str]:
    """Regular forms of a verb or noun, without the word itself."""
    stem = word[:-1] if word.endswith("e") else word
    out = {word + "s", stem + "ed", stem + "ing"}
    if word.endswith(("s", "x", "z", "ch", "sh")):
        out = {word + "es", word + "ed", word + "ing"}
    elif word.endswith("y") and word[-2:-1] not in _VOWELS:
        out = {word[:-1] + "ies", word[:-1] + "ied", word + "ing"}
    return out


def lower(text: str) -> str:
    """Lower case at equal length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def resolve(matches: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(tokens, start, end, phrase) accepted by falling tokens and rising start, none touching another."""
    taken: list[tuple[int, int]] = []  # none overlaps another, so starts and ends rise together
    kept = []
    for m in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
        i = bisect_left(taken, (m[2], 0))
        if i == 0 or taken[i - 1][1] <= m[1]:
            taken.insert(i, (m[1], m[2]))
            kept.append(m)
    return sorted(kept, key=lambda m: m[1])


@lru_cache(8)
def automaton(lists: tuple[str, ...], forms: bool) -> ahocorasick.Automaton:
    """Each phrase with (list, phrase as listed, tokens); with ``forms``, regular inflections of single words, too."""
    entries: dict[str, list[tuple[str, str, int]]] = {}
    for name in (*lists, *(EXCEPTIONS[x] for x in lists if x in EXCEPTIONS)):
        for p in phrases(name):
            tokens = len(re.findall(r"[\w'’-]+|[^\w\s]", p))
            entries.setdefault(p.lower(), []).append((name, p.lower(), tokens))
            if forms and name in INFLECTED and p.isalpha():
                for f in inflections(p):
                    if f not in phrases(name):
                        entries.setdefault(f, []).append((name, p.lower(), 1))
    a = ahocorasick.Automaton()
    for p, e in entries.items():
        a.add_word(p, (len(p), e))
    a.make_automaton()
    return a


def _joins(text: str, i: int) -> bool:
    """Whether a token runs across the border before ``text[i]``."""
    if not 0 < i < len(text):
        return False
    a, b = text[i - 1], text[i]
    word = lambda c: c.isalnum() or c == "_"
    if word(a):
        return word(b) or b in "'’-" and i + 1 < len(text) and word(text[i + 1])
    return a in "'’-" and word(b) and i > 1 and word(text[i - 2])


def find(text: str, lists: tuple[str, ...], forms: bool) -> list[tuple]:
    low = lower(text)
    found: dict[str, list] = {}
    for end, (n, entries) in automaton(lists, forms).iter(low):
        start, end = end - n + 1, end + 1
        if not _joins(low, start) and not _joins(low, end):
            for name, phrase, tokens in entries:
                found.setdefault(name, []).append((tokens, start, end, phrase))
    out = []
    for name in lists:
        shielded = [(s, e) for _, s, e, _ in found.get(EXCEPTIONS.get(name, ""), ())]
        for _, s, e, phrase in resolve(found.get(name, [])):
            if not any(a <= s and e <= b for a, b in shielded):
                last, ahead = s - 1, NOT_SPACE.search(low, e)
                while last >= 0 and low[last].isspace():
                    last -= 1
                before, after = low[last] if last >= 0 else "", ahead[0] if ahead else ""
                out.append((name, phrase, s, e, before, after))
    return out


def hits(text: Column, lists: tuple[str, ...], forms: bool = False) -> Column:
    """All accepted phrases of the lists: list, phrase, span, and the nearest characters before and after that are no space."""

    @F.pandas_udf(HIT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("list", "phrase", "start", "end", "before", "after")
        for series in batches:
            yield pd.Series([[dict(zip(names, h)) for h in find(t, lists, forms)] if t else [] for t in series], dtype=object)

    return run(text)


def flattest_run(lengths: list[int], least: int = 3) -> tuple[int, int] | None:
    """The longest run of near-equal lengths: greatest less least within max(2, a quarter of the mean); the first of equals."""
    best: tuple[int, int] | None = None
    n = len(lengths)
    low_of, high_of = _extremes(lengths, np.minimum), _extremes(lengths, np.maximum)
    for i in range(n):
        wanted = max(least, best[1] - best[0] + 1 if best else 0)
        if i + wanted > n:
            break
        # no run from here is longer unless so many lengths are within what the greatest of them would allow
        low, high = _extreme(low_of, i, i + wanted, min), _extreme(high_of, i, i + wanted, max)
        if high - low > max(2, 0.25 * high):
            continue
        low = high = lengths[i]
        total = 0
        for j in range(i, n):
            low, high, total = min(low, lengths[j]), max(high, lengths[j]), total + lengths[j]
            if high - low > max(2, 0.25 * total / (j - i + 1)):
                break
            if j - i + 1 >= wanted:
                best = (i, j + 1)
    return best


def _extremes(x: list[int], f: np.ufunc) -> list[np.ndarray]:
    """Least or greatest values of runs of 1, 2, 4 and so on."""
    out = [np.asarray(x)]
    while len(out[-1]) > 1 << (len(out) - 1):
        out.append(f(out[-1][: -(1 << (len(out) - 1))], out[-1][1 << (len(out) - 1) :]))
    return out


def _extreme(of: list[np.ndarray], i: int, j: int, f) -> int:
    k = (j - i).bit_length() - 1
    return int(f(of[k][i], of[k][j - (1 << k)]))
