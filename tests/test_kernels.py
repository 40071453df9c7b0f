"""The kernels against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.diversity import window_distinct
from lectern.functions.lexicon import find, flattest_run, inflections, resolve
from lectern.operators.markup import blank_markup


def column(spark, texts, build):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    return [x[0] for x in df.select("i", build.alias("v")).orderBy("i").select("v").collect()]


TEXTS = ["", "one", "a\n\nb\n \nc", "Hello there. Is it (really) so? \"Yes.\" No…\nnext line", "x" * 700, " ".join(f"w{i}." for i in range(900)), "été déjà-vu don't 3.5 -- a--b 😀 x", "- one\n- two\n* three", "  lead", "... and"]


def test_prefix_over_several_blocks(spark):
    n = [random.Random(1).randint(0, 9) for _ in range(1500)]
    df = spark.createDataFrame([(n,), ([],)], "n array<int>").coalesce(1)
    got = [x[0] for x in df.select(T.prefix(F.col("n"))).collect()]
    assert got[0] == np.concatenate([[0], np.cumsum(n)[:-1]]).tolist() and got[1] == []


def test_spans_equal_finditer(spark):
    for rx in ("[a-z]+", "o", r"[.?]", "(?<=e)l"):
        both = zip(column(spark, TEXTS, T.spans("text", rx)), column(spark, TEXTS, T._spans_of(F.col("text"), rx)), TEXTS)
        for got, other, t in both:
            assert [tuple(x) for x in got] == [tuple(x) for x in other] == [(*m.span(), m[0]) for m in re.finditer(rx, t)]


def test_sentences_cover_the_text(spark):
    for got, t in zip(column(spark, TEXTS, T.sentences(F.col("text"))), TEXTS):
        assert all(t[s["start"] : s["end"]] == s["text"] and s["text"].strip() for s in got)
        assert "".join(s["text"] for s in got).replace("\n", "").replace(" ", "") == t.replace("\n", "").replace(" ", "")


def test_sentence_boundaries(spark):
    texts = ["One. Two! Three? Four", 'He said "go." Then left.', "Head\n\nBody text", "- a\n- b", "wrapped\nline goes on", "A.\nB.\nC.\nD.\nE", "3.5 is one... Yes"]
    assert [len(x) for x in column(spark, texts, T.sentences(F.col("text")))] == [4, 2, 2, 2, 1, 5, 2]


def test_words_and_grade(spark):
    assert column(spark, ["don't co-op 3 $ _ --"], T.words(F.col("text")))[0] == ["don't", "co-op", "3", "$"]
    assert column(spark, ["don't co-op! a_b _"], T.letters(F.col("text")))[0] == 4 + 4 + 3
    grade = lambda a, b, c: column(spark, ["x"], T.reading_grade(F.lit(a), F.lit(b), F.lit(c)))[0]
    assert (grade(100, 20, 2), grade(0, 0, 0), grade(4, 4, 1)) == (7, 0, 0)
    assert column(spark, ["one two three, four five six seven eight — nine"], T.segments(F.col("text")))[0] == [3, 5, 1]


def test_paragraphs(spark):
    got = column(spark, ["a\n\nb\n \n\n c", "\n\nx"], T.paragraphs(F.col("text")))
    assert [[p["text"] for p in x] for x in got] == [["a", "b", "c"], ["x"]]
    assert column(spark, ["ab\ncde\nf"], F.array(*(T.line_of(F.col("text"), F.lit(k)) for k in (0, 3, 7))))[0] == [1, 2, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=260))
def test_window_distinct(tokens):
    n, windows, distinct = window_distinct(np.array(tokens, object))
    if len(tokens) < 100:
        assert distinct == len(set(tokens))
    else:
        assert (windows, distinct) == (len(tokens) - 99, sum(len(set(tokens[i : i + 100])) for i in range(len(tokens) - 99)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 5)), max_size=12))
def test_resolution(items):
    matches = [(n, s, s + n, "p") for s, n in items]
    kept = resolve(matches)
    used: set[int] = set()
    want = []
    for m in sorted(matches, key=lambda m: (-m[0], m[1])):
        if not used & set(range(m[1], m[2])):
            used |= set(range(m[1], m[2]))
            want.append(m)
    assert kept == sorted(want, key=lambda m: m[1])


def test_lexicon_edges():
    assert [h[1] for h in find("In order to accomplish: accomplishment, re-accomplish", ("complex",), False)] == ["in order to", "accomplish"]
    assert {"tries", "tried", "trying"} == inflections("try") and "delving" in inflections("delve")
    assert flattest_run([5, 5, 6, 20, 7, 7, 7, 8]) == (4, 8) and flattest_run([1, 9, 1]) is None


def test_markup_keeps_length_and_newlines(spark):
    html = ["<p>a<script>x\ny</script><!-- c -->b</p>", "no tags", "<img src=q alt='z'> t"]
    md = ["# H\n\n`code` **b** [t](u) ![a](b)\n\n> q\n\n- i\n\n| a | b |\n|---|---|\n", "snake_case _em_ https://x.y/z", "---\nk: v\n---\ntext\n---\n", "```\nx\n```\n[1]: http://a b\n"]
    for kind, texts in (("html", html), ("markdown", md)):
        df = blank_markup(spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1), kind)
        for x in df.select("text", "_analysis", "_marks").collect():
            assert len(x["text"]) == len(x["_analysis"])
            assert all(a == "\n" for a, b in zip(x["_analysis"], x["text"]) if b == "\n")
            assert all(0 <= m["start"] <= m["end"] <= len(x["text"]) for m in x["_marks"])
