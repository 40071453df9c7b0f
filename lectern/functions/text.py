"""Columns over a text: tokens, sentences, paragraphs and matches with their offsets, all inside the row.

No row is exploded and nothing is shuffled: a text's tokens, sentences and matches are arrays beside it. Offsets count
code points from 0. Running sums are taken in blocks (``prefix``), so they stay near linear in long texts.

Character classes are written out, as the regex dialects of Java, RE2 and Python differ on ``\\s``, ``\\w`` and ``\\b``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r" \t\n\r\f\x0b"
WORD = r"_*[\p{L}\p{N}][\p{L}\p{N}_]*(?:['’-][\p{L}\p{N}_]+)*"
#: The same without backtracking, which RE2 has no sign for.
_WORD = r"_*+[\p{L}\p{N}][\p{L}\p{N}_]*+(?:['’-][\p{L}\p{N}_]++)*+"
SYMBOL = r"[^\p{L}\p{N}\p{P}\p{Z}\p{C}]"
#: A word: letters and digits with inner apostrophes and hyphens, or a symbol that is not punctuation.
WORDS = f"{WORD}|{SYMBOL}"
#: Every character of a text belongs to exactly one token.
COVER = rf"{WORD}|--|[{WS}]+|(?s:.)"
CLOSERS = r"[\"'”’)\]}*_]"
#: Before and after a whole token.
LEFT = r"(?<![\p{L}\p{N}_])(?<![\p{L}\p{N}_]['’-])"
RIGHT = r"(?![\p{L}\p{N}_]|['’-][\p{L}\p{N}_])"

# a sentence takes runs without an end in them; every run is possessive, so matching is linear and without recursion
_RUN = rf"[^.!?…{WS}]++|[.!?…]++{CLOSERS}*+(?![{WS}])"
_STOP = rf"(?:[.!?…]++{CLOSERS}*+)?"
SENTENCE = rf"[{WS}]*+(?=[^{WS}])(?:{_RUN}|(?![ \t\r\f\x0b]*+\n[ \t\r\f\x0b]*+\n)(?![ \t\r\f\x0b]*+\n[ \t\r\f\x0b]*+(?:[*•+]|-(?!-)))[{WS}]++(?!\z))*+{_STOP}"
#: Of texts whose lines are sentences: a newline ends one, too.
SENTENCE_BY_LINE = rf"[{WS}]*+(?=[^{WS}])(?:{_RUN}|(?![ \t\r\f\x0b]*+\n)[{WS}]++(?!\z))*+{_STOP}"
SEGMENT_BREAK = r"--|[,;:—–()]"

BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and named: plans grow with what is written, not with its powers."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(block: Column, start: Column) -> Column:
    return F.aggregate(
        block,
        F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )


def prefix(lengths: Column) -> Column:
    """For each element the sum of those before it."""

    def of(n: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(n, b * BLOCK + 1, BLOCK))
        return let(blocks, by_block)

    def by_block(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x))
        return let(_fold(sums, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda block, i: _fold(block, F.get(starts, i)))))

    return let(lengths, of)


def pieces(parts: Column) -> Column:
    """Contiguous parts of a text as (start, end, text)."""
    place = lambda t, s: F.transform(t, lambda x, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).cast("int").alias("end"), x.alias("text")))
    return let(parts, lambda t: let(prefix(F.transform(t, F.length)), lambda s: place(t, s)))


SPANS = "array<struct<start:int,end:int,text:string>>"


def _sql_fold(block: str, start: str) -> str:
    return f"aggregate({block}, named_struct('at', cast({start} as int), 'out', cast(array() as array<int>)), (acc, x) -> named_struct('at', cast(acc.at + x as int), 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"


def _sql_let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _sql_prefix(lengths: str) -> str:
    blocks = f"transform(sequence(0, greatest(0, cast(floor((size(n) - 1) / {BLOCK}) as int))), b -> slice(n, b * {BLOCK} + 1, {BLOCK}))"
    starts = _sql_fold("transform(bl, k -> aggregate(k, 0, (a, x) -> cast(a + x as int)))", "0")
    return _sql_let(lengths, "n", _sql_let(blocks, "bl", _sql_let(starts, "st", f"flatten(transform(bl, (k, i) -> {_sql_fold('k', 'get(st, i)')}))")))


def _quoted(rx: str) -> str:
    return "'" + rx.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str | Column, rx: str) -> Column:
    """All matches of a pattern as (start, end, text); the pattern must not match the empty string.

    Written as one SQL expression: built from columns, its lambdas cost the driver thousands of calls a pattern.
    """
    if not isinstance(text, str):
        return let(text, lambda t: _spans_of(t, rx))
    found = f"named_struct('g', split({text}, {_quoted(rx)}, -1), 'm', regexp_extract_all({text}, {_quoted(rx)}, 0))"
    starts = _sql_prefix("transform(p.m, (x, i) -> cast(length(get(p.g, i)) + length(x) as int))")
    placed = "transform(p.m, (x, i) -> named_struct('start', cast(get(s, i) + length(get(p.g, i)) as int), 'end', cast(get(s, i) + length(get(p.g, i)) + length(x) as int), 'text', x))"
    return F.expr(f"case when rlike({text}, {_quoted(rx)}) then {_sql_let(found, 'p', _sql_let(starts, 's', placed))} else cast(array() as {SPANS}) end")


def _spans_of(text: Column, rx: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    gap = lambda g, i: F.length(F.get(g, i))

    def place(g: Column, m: Column, s: Column) -> Column:
        return F.transform(m, lambda x, i: F.struct((F.get(s, i) + gap(g, i)).cast("int").alias("start"), (F.get(s, i) + gap(g, i) + F.length(x)).cast("int").alias("end"), x.alias("text")))

    out = let(F.split(text, rx, -1), lambda g: let(found, lambda m: let(prefix(F.transform(m, lambda x, i: (gap(g, i) + F.length(x)).cast("int"))), lambda s: place(g, m, s))))
    return F.when(text.rlike(rx), out).otherwise(F.array().cast(SPANS))


def line_oriented(text: Column) -> Column:
    """At least five lines with text, and four in five of them end as sentences do."""
    lines = F.regexp_count(text, F.lit(rf"[^\n]*[^\n{WS}][^\n]*"))
    ended = F.regexp_count(text, F.lit(rf"[.!?:;…]{CLOSERS}*[ \t\r\f\x0b]*(?=\n|\z)"))
    return (lines >= 5) & (ended * 5 >= lines * 4)


def sentence_parts(text: Column) -> Column:
    """The sentences, each with the white space before it."""
    by = lambda rx: F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    return F.when(line_oriented(text), by(SENTENCE_BY_LINE)).otherwise(by(SENTENCE))


def sentences(text: Column) -> Column:
    """(start, end, text, words, letters) of each sentence, without the white space round it."""
    trim = lambda t: F.ltrim(t, F.lit(" \t\n\r\f\x0b"))
    return F.transform(
        pieces(sentence_parts(text)),
        lambda p: F.struct((p["end"] - F.length(trim(p["text"]))).cast("int").alias("start"), p["end"].alias("end"), trim(p["text"]).alias("text"), F.regexp_count(p["text"], F.lit(WORDS)).alias("words"), letters(p["text"]).alias("letters")),
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def letters(text: Column) -> Column:
    """ASCII letters, digits and underscores inside words; letters and digits are always inside one."""
    plain = F.length(F.regexp_replace(text, "[^A-Za-z0-9]++", ""))
    exact = F.length(F.regexp_replace(F.array_join(words(text), " "), "[^A-Za-z0-9_]++", ""))
    return F.when(F.contains(text, F.lit("_")), exact).otherwise(plain)


def segments(text: Column) -> Column:
    """Words between the breaks inside one sentence, without empty runs."""
    return F.filter(F.transform(F.split(text, SEGMENT_BREAK, -1), lambda s: F.regexp_count(s, F.lit(WORDS))), lambda n: n > 0)


PARAGRAPH_BREAK = rf"\n[ \t]*\n[{WS}]*"


def paragraphs(text: Column) -> Column:
    """(start, end, text) of runs between blank lines; empty ones are left out."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH_BREAK), F.lit(0))
    lengths = lambda g, m: F.transform(g, lambda x, i: (F.length(x) + F.coalesce(F.length(F.get(m, i)), F.lit(0))).cast("int"))
    place = lambda g, s: F.transform(g, lambda x, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).cast("int").alias("end"), x.alias("text")))
    out = let(F.split(text, PARAGRAPH_BREAK, -1), lambda g: let(prefix(let(found, lambda m: lengths(g, m))), lambda s: place(g, s)))
    return F.filter(out, lambda p: p["end"] > p["start"])


def alpha_tokens(text: Column) -> Column:
    """Lower-cased tokens that are letters and nothing else."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: w.rlike(r"^\p{L}+$")), F.lower)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def variation(lengths: Column) -> Column:
    """Population deviation by mean, from whole sums; 0 for fewer than two lengths."""
    squares = lambda x: total(F.transform(x, lambda v: v * v)).cast("double")
    sums = lambda x: F.struct(F.size(x).cast("double").alias("n"), total(x).cast("double").alias("s"), squares(x).alias("q"))
    return let(let(lengths, sums), lambda t: F.when((t["n"] >= 2) & (t["s"] > 0), F.sqrt(t["n"] * t["q"] - t["s"] * t["s"]) / t["s"]).otherwise(F.lit(0.0)))


def reading_grade(n_letters: Column, n_words: Column, n_sentences: Column) -> Column:
    """The automated readability index, rounded half up, at least 0."""
    ari = n_letters / n_words * F.lit(4.71) + n_words / n_sentences * F.lit(0.5) - F.lit(21.43)
    return F.when((n_words > 0) & (n_sentences > 0), F.greatest(F.floor(ari + F.lit(0.5)).cast("int"), F.lit(0))).otherwise(F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """Rounded to even by the exact binary value, as no built-in does: theirs go by the shortest decimal form."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if pd.isna(v) else round(v, digits)).astype("float64")

    return run(value)


def line_of(text: Column, at: Column) -> Column:
    """The 1-based line of an offset."""
    head = F.substring(text, F.lit(1), at)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(text: Column, at: Column) -> Column:
    """The 1-based place of an offset in its line."""
    return (at - F.length(F.substring(text, F.lit(1), at)) + F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)) + 1).cast("int")


def flat(s: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(s, rf"[{WS}]+", " "))
