"""Markup of Markdown and HTML: blanked at equal length, and indexed as typed spans.

Each step blanks one construct in what the steps before left, so their order is part of the result. Texts are plain Python,
read in the kernel that runs the rules; as columns, each step was an interpreted expression over arrays of matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.reading import pattern, slices
from lectern.functions.text import WS

MARK = "array<struct<start:int,end:int,kind:string>>"

# pieces of the patterns: line edges, blanks, what ends a tag
START, STOP, GAP, LINE, SOLID = r"(?<=\n|\A)", r"(?=\n|\z)", r"[ \t]*", r"[^\n]*", r"[^\s\n]"
NAME_END, TAG_END = r"(?![\p{L}\p{N}_])", "[^>]*>"
COMMENT = "<!--.*?-->"


def element(name: str) -> str:
    return f"<{name}{NAME_END}{TAG_END}.*?</{name}>"


IMG = f"(?i)<img{NAME_END}{TAG_END}"
ALT = r"(?i)(?<![\p{L}\p{N}_])alt\s*=\s*" + "(" + "|".join(f"{mark}[^{mark}]*{mark}" for mark in "\"'") + ")"
HTML_BLOCK = "(?is)" + "|".join([element("script"), element("style"), COMMENT])
HTML_TAG = f"</?[a-zA-Z]{TAG_END}"
#: (kind, pattern) of the Markdown constructs that are blanked whole, up to the images
FIRST = (("frontmatter", rf"\A---{GAP}\n(?:{LINE}\n)*?---{GAP}{STOP}"), ("fence", "(?s)" + "|".join(f"{mark * 3}.*?{mark * 3}" for mark in "`~")), ("inline-code", r"`[^`\n]+`"))
SECOND = (("html", f"(?s){COMMENT}|{HTML_TAG}"), ("ref-def", rf"{START}{GAP}\[[^\]\n]+\]:[ \t]+{SOLID}{LINE}"), ("citation", rf"{START}{GAP}\[[0-9]+\][ \t]+{SOLID}{LINE}"))
LABEL, ADDRESS = r"([^\]]*)", "(" + r"\]\(" + ")" + "([^)]*)" + r"(\))"
IMAGE, LINK = rf"(!\[){LABEL}{ADDRESS}", rf"(\[){LABEL}{ADDRESS}"
SCHEME = "https?://"
THIRD = (("url", rf"<{SCHEME}[^>\s]+>"), ("url", rf"(?:{SCHEME}|www\.)[^\s<>()\[\]]+"))
HEADING = rf"{START}#{{1,6}}[{WS}]+"
RULE = rf"{START}[ \t|:=-]*[-=][ \t|:=-]*{STOP}"
ROW = rf"{START}[^\n|]*\|[^\n|]*\|{LINE}"
QUOTE = rf"{START}[{WS}]*>+[{WS}]?"
ITEM = r"(?:[-*+]|[0-9]+[.)])"
LIST = rf"{START}[{WS}]*{ITEM}[{WS}]+"
BAR, NEAR = "_{1,3}", "[A-Za-z0-9]"
EMPHASIS = rf"\*{{1,3}}|~~|(?<!{NEAR}){BAR}(?={NEAR})|(?<={NEAR}){BAR}(?!{NEAR})"


KINDS = ("text", "markdown", "html")


def mask(s: str) -> str:
    """Every character but newlines as a space."""
    return "\n".join(" " * len(x) for x in s.split("\n"))


class Markup:
    """A text as far as it is blanked, and its marks so far."""

    def __init__(self, text: str):
        self.text, self.marks = text, []

    def mark(self, start: int, end: int, kind: str) -> None:
        self.marks.append({"start": start, "end": end, "kind": kind})

    def images(self) -> None:
        """Each image tag, and its alternative text; of zero length at the tag's start if it has none."""
        for m in pattern(IMG).finditer(self.text):
            alt = pattern(ALT).search(m[0])
            self.mark(*m.span(), "image")
            self.mark(*((m.start() + alt.start(1) + 1, m.start() + alt.end(1) - 1) if alt else (m.start(), m.start())), "image-alt")

    def find(self, rx: str, kind: str) -> None:
        for m in pattern(rx).finditer(self.text):
            self.mark(*m.span(), kind)

    def blank(self, rx: str, kind: str) -> None:
        self.find(rx, kind)
        self.put(rx, lambda m: mask(m[0]))

    def put(self, rx: str, by: Callable[[re.Match], str]) -> None:
        """Matches replaced at equal length."""
        self.text = pattern(rx).sub(by, self.text)

    def parts(self, rx: str, whole: str | None, label: str) -> None:
        """Of images or links the whole, its label, which stays, and its address."""
        for m in pattern(rx).finditer(self.text):
            if whole:
                self.mark(*m.span(), whole)
            self.mark(*m.span(2), label)
            self.mark(*m.span(4), "link-url")
        self.put(rx, lambda m: mask(m[1]) + m[2] + mask(m[3]) + mask(m[4]) + mask(m[5]))


def html(d: Markup) -> None:
    """Scripts, styles, comments, then tags."""
    if "<" in d.text:
        d.images()
        d.blank(HTML_BLOCK, "html")
        d.blank(HTML_TAG, "html")


def _bullet(m: re.Match) -> str:
    """A bullet becomes a newline, so that each item begins a sentence."""
    lead = len(m[0]) - len(m[0].lstrip(" \t\n\r\f\x0b"))
    return mask(m[0][:lead]) + "\n" + mask(m[0][lead + 1 :])


def markdown(d: Markup) -> None:
    """The Markdown steps in their order."""
    for kind, rx in FIRST:
        d.blank(rx, kind)
    d.images()
    for kind, rx in SECOND:
        d.blank(rx, kind)
    d.parts(IMAGE, "image", "image-alt")
    d.parts(LINK, None, "link-text")
    for kind, rx in THIRD:
        d.blank(rx, kind)
    # a heading runs from its marker to the end of the line
    d.find(HEADING, "heading-marker")
    for m in pattern(f"({HEADING})[^\n]*").finditer(d.text):
        d.mark(m.end(1), m.end(), "heading")
    d.put(HEADING, lambda m: mask(m[0]))
    d.blank(RULE, "rule")
    d.find(ROW, "table-row")
    if pattern(ROW).search(d.text):
        d.text = "\n".join(x.replace("|", " ") if x.count("|") > 1 else x for x in d.text.split("\n"))
    d.blank(QUOTE, "blockquote")
    d.find(LIST, "list-marker")
    d.put(LIST, _bullet)
    d.blank(EMPHASIS, "emphasis")


STEPS = {"html": html, "markdown": markdown}


def marked(text: str, kind: str) -> tuple[str, list[dict]]:
    """A text with its markup blanked at equal length, and the marks in source order."""
    if kind not in STEPS:
        return text, []
    STEPS[kind](d := Markup(text))
    d.marks.sort(key=lambda m: (m["start"], m["end"]))
    return d.text, d.marks


def blank_markup(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """``df`` with ``_analysis``, of equal length to the text, and ``_marks``, in source order, for text, markdown or html."""
    if kind == "text":
        return df.withColumn("_analysis", F.col(text)).withColumn("_marks", F.array().cast(MARK))
    known(kind)

    @F.arrow_udf(f"struct<analysis:string,marks:{MARK}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = [pa.field("analysis", pa.string()), pa.field("marks", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))]
        for batch in batches:
            parts = []
            for rows in slices(batch):
                done = [(None, []) if t is None else marked(t, kind) for t in (x.as_py() for x in rows)]
                parts.append(pa.StructArray.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(fields)], fields=fields))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    df = df.withColumn("_told", run(F.col(text)))
    return df.withColumns({"_analysis": F.col("_told.analysis"), "_marks": F.col("_told.marks")}).drop("_told")


def known(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}: text, markdown or html")
    return kind
