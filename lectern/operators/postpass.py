"""What happens to a document's findings, in this order: suppression by line, quotations, precedence, counts, budgets,
demotion, the document's grade, and the order of the report. All inside the row, over Arrow batches; a finding dropped early
neither wins precedence nor spends a budget."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lectern.config import Config
from lectern.functions import text as T
from lectern.functions.reading import KINDS, MEASURES, VOCABULARY, Reading, asked, columns, slices
from lectern.functions.tables import BUDGET_CODES, BUDGETS, PRECEDENCE
from lectern.operators import patterns as P
from lectern.operators.markup import known, marked
from lectern.operators.parsed import STATISTICS, parsed
from lectern.operators.registry import ENTRIES
from lectern.operators.rules import Document, found

CATEGORIES = {"adverbs": "NB301", "complexWords": "NB401", "hardSentences": "NB202", "passiveVoices": "NB302", "qualifiers": "NB303", "veryHardSentences": "NB201"}
SEVERITIES = {"error": 4.0, "warning": 2.0, "info": 1.0}


FIELDS = ("code", "name", "message", "severity", "suggestion", "applicability", "text", "start", "end", "line", "end_line", "col", "end_col")
SETTLED = "array<struct<code:string,name:string,message:string,severity:string,suggestion:string,applicability:string,text:string,start:int,end:int,line:int,end_line:int,col:int,end_col:int>>"
QUOTED, QUOTE_LINES = re.compile(P.QUOTED), re.compile(r"^[ \t]*>[^\n]*(?:\n[ \t]*>[^\n]*)*", re.M)
SUPPRESS, SPACES = re.compile(P.SUPPRESS, re.A), re.compile(f"[{T.WS}]+")


class Spans:
    """Spans that answer by binary search: starts in order, and the greatest end up to each."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.reach = list(accumulate((e for _, e in self.spans), max))

    def contains(self, start: int, end: int) -> bool:
        """Whether one of them holds all of a span."""
        i = bisect_right(self.starts, start)
        return i > 0 and self.reach[i - 1] >= end

    def meets(self, start: int, end: int) -> bool:
        """Whether one of them overlaps a span."""
        i = bisect_left(self.starts, end)
        return i > 0 and self.reach[i - 1] > start

    def overlap(self, start: int, end: int) -> int:
        """Characters that a span shares with each of them, summed."""
        i, out = bisect_left(self.starts, end), 0
        while i > 0 and self.reach[i - 1] > start:
            i -= 1
            out += max(0, min(end, self.spans[i][1]) - max(start, self.spans[i][0]))
        return out


def flat(text: str) -> str:
    return SPACES.sub(" ", text).strip(" ")


class Lines:
    """Offsets of a text as 1-based lines and columns."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


def suppressed(original: str) -> dict[int, set[str]]:
    """Lines that suppress findings, each with the codes it names; none means all."""
    if not SUPPRESS.search(original):
        return {}
    out = {}
    for n, line in enumerate(original.split("\n"), 1):
        if m := SUPPRESS.search(line):
            out[n] = {flat(c).upper() for c in m[1].split(",")} - {""}
    return out


def quotations(analysis: str, kind: str) -> tuple[Spans, set[tuple[int, int]]]:
    """(regions of two and more words, inner spans of all quotations)"""
    found = [m.span() for m in QUOTED.finditer(analysis)]
    regions = [(s, e) for s, e in found if " " in flat(analysis[s:e])]
    return Spans(regions), {(s + 1, e - 1) for s, e in found}


def quoted_lines(original: str, kind: str) -> Spans:
    spans = ((m.start(), m.end() - m[0].endswith("\r")) for m in QUOTE_LINES.finditer(original)) if kind == "markdown" else ()
    return Spans(spans)


def settle(told: list[dict], original: str, analysis: str, n_words: int, readability: str, grade: int, c: Config, kind: str) -> tuple[list[dict], dict[str, int]]:
    """A document's findings after all passes, and counts by category."""
    at = Lines(original)
    off = suppressed(original)
    kept = []
    for f in told:
        f["line"], f["col"] = at(f["start"])
        f["end_line"], f["end_col"] = at(f["end"])
        codes = off.get(f["line"])
        if codes is None or codes and f["code"] not in codes:
            kept.append(f)
    if kept:
        regions, mentions = quotations(analysis, kind)
        lines = quoted_lines(original, kind)
        span = lambda f: (f["start"], f["end"])
        kept = [f for f in kept if not regions.contains(*span(f)) and not lines.contains(*span(f)) and span(f) not in mentions]
        for f in kept:
            if f["code"] in ("NB201", "NB202") and (regions.overlap(*span(f)) + lines.overlap(*span(f))) * 2 > f["end"] - f["start"]:
                f["severity"] = "info"
        winners = {loser: Spans(span(f) for f in kept if f["code"] in codes) for loser, codes in PRECEDENCE.items()}
        kept = [f for f in kept if f["code"] not in winners or not winners[f["code"]].meets(*span(f))]
    n = Counter(f["code"] for f in kept)
    rates = dict(zip(BUDGET_CODES, BUDGETS[c.target])) | c.budgets
    within = {code for code, rate in rates.items() if n[code] <= max(2, math.ceil(rate * n_words / 1000))}
    for f in kept:
        if f["code"] in within or f["code"] == "NB202" and readability == "normal":
            f["severity"] = "info"
    if c.max_grade is not None and not c.ignored("NB101") and grade > c.max_grade:
        values = ("NB101", ENTRIES["NB101"].name, f"grade {grade} is above {c.max_grade}", "error", None, "advisory", "", 0, 0, 1, 1, 1, 1)
        kept.append(dict(zip(FIELDS, values)))
    kept.sort(key=lambda f: (f["line"], f["col"], f["code"]))
    return kept, {name: n[code] for name, code in CATEGORIES.items()}


def analyzed_part(batch: pa.RecordBatch, c: Config, kind: str, names: tuple[str, ...], schema: pa.Schema) -> pa.RecordBatch:
    """Some rows with what ``names`` asks, ``findings`` and ``counts``, in the order of a schema. One document's words are held at a time."""
    of, codes = {name: batch.column(name) for name in batch.schema.names}, c.reported()
    asked_of, blanked, done, parses = [], [], [], []
    for i in range(len(batch)):
        value = lambda name: of[name][i].as_py()  # noqa: B023, E731
        original = value("_original")
        d = Document(original, *marked(original, kind), value("name"), kind, c)
        told = found(d, codes)
        if "_tokens" in of:
            more, numbers = parsed(d.text, value("_tokens") or [], codes, d.original, kind, c.ratings)
            told = [*told, *more]
            parses.append(numbers)
        done.append(settle(told, d.original, d.text, d.n_words, d.readability, d.grade, c, kind))
        asked_of.append(asked(d, names))
        blanked.append(d.text)
    of |= dict(zip(names, columns(names, asked_of))) | ({"_analysis": pa.array(blanked, pa.string())} if kind != "text" else {})
    of |= {name: pa.array([n[name] for n in parses], pa.float64()) for name in STATISTICS if "_tokens" in of}
    of["findings"] = pa.array([f for f, _ in done], schema.field("findings").type)
    of["counts"] = pa.array([list(n.items()) for _, n in done], schema.field("counts").type)
    return pa.RecordBatch.from_arrays([of[name] for name in schema.names], names=schema.names)


def analyze_rows(df: DataFrame, c: Config, kind: str, vocabulary: bool) -> DataFrame:
    """``df`` with the statistics of each document, ``findings`` settled and ``counts`` by category: one kernel, a few rows of a
    batch at a time, each in linear time.

    It reads ``name`` and ``_original``; markup is blanked here, and what that leaves is ``_analysis``. With a column ``_tokens``,
    findings of the rules that read a parse join the others, and its statistics are added.
    """
    names = (*MEASURES, *(VOCABULARY if vocabulary else ()))
    schema = StructType([f for f in df.schema.fields if f.name != "_tokens"])
    if known(kind) != "text":
        schema = schema.add("_analysis", "string")
    for name in names:
        schema = schema.add(name, _parse_datatype_string(KINDS[name]))
    schema = schema.add("findings", _parse_datatype_string(SETTLED)).add("counts", _parse_datatype_string("map<string,int>"))
    for name in STATISTICS if "_tokens" in df.columns else ():
        schema = schema.add(name, "double")
    kinds = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                yield analyzed_part(rows, c, kind, names, kinds)

    return df.mapInArrow(run, schema)


RAW = "array<struct<code:string,message:string,suggestion:string,text:string,start:int,end:int>>"


def unsettled(text: Column, codes: tuple[str, ...]) -> Column:
    """What the rules of some codes find in a plain text, before the passes over findings."""
    c = Config(select=codes)

    @F.arrow_udf(RAW)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(k, pa.int32() if k in ("start", "end") else pa.string()) for k in ("code", "message", "suggestion", "text", "start", "end")]))
        for batch in batches:
            parts = [pa.array([[{k.name: f[k.name] for k in kind.value_type} for f in found(Document(t or "", t or "", [], None, "text", c), frozenset(codes))] for t in rows.to_pylist()], kind) for rows in slices(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run(text)


# -- hotspots

SPOT = "line int, end_line int, words int, issues int, weight double, density double, codes array<struct<code:string,n:int>>, preview string, rank int"


def spots(original: str, analysis: str, findings: list[dict], limit: int) -> list[dict]:
    """The paragraphs with the most weight of findings a hundred words, worst first."""
    at, starts, mine = Lines(original), *_in_paragraphs(analysis, findings)
    out = []
    for (a, b), found_ in zip(starts, mine):
        if found_:
            words, weight = sum(1 for w in SPACES.split(analysis[a:b]) if w), sum((SEVERITIES[f["severity"]] for f in found_), 0.0)
            shown = flat(original[a:b])
            n = Counter(f["code"] for f in found_)
            codes = [{"code": k, "n": v} for k, v in sorted(n.items(), key=lambda x: (-x[1], x[0]))]
            out.append({"line": at(a)[0], "end_line": at(max(a, b - 1))[0], "words": words, "issues": len(found_), "weight": weight, "density": weight / max(words, 25) * 100, "codes": codes, "preview": shown if len(shown) <= 60 else shown[:59].rstrip(" ") + "…"})
    out.sort(key=lambda s: (-s["density"], -s["weight"], s["line"]))
    return [s | {"rank": i} for i, s in enumerate(out[:limit], 1)]


def _in_paragraphs(analysis: str, findings: list[dict]) -> tuple[list[tuple[int, int]], list[list[dict]]]:
    paras = Reading(analysis).paragraphs
    first, mine = [a for a, _ in paras], [[] for _ in paras]
    for f in findings:
        i = bisect_right(first, f["start"]) - 1
        if i >= 0 and f["start"] < paras[i][1]:
            mine[i].append(f)
    return paras, mine


def hotspot_rows(df: DataFrame, limit: int) -> DataFrame:
    """A row for each spot, beside the columns of ``df`` that are not read."""
    read = ("_original", "_analysis", "findings")
    kept = [f.name for f in df.schema.fields if f.name not in read]
    schema = StructType([f for f in df.schema.fields if f.name in kept] + _parse_datatype_string(SPOT).fields)
    kinds = to_arrow_schema(schema, prefers_large_types=False)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found_ = [spots(*x, limit) for x in zip(*(batch.column(x).to_pylist() for x in read))]
        rows = pa.array([i for i, x in enumerate(found_) for _ in x], pa.int32())
        told = [s for x in found_ for s in x]
        arrays = [batch.column(k).take(rows) if k in kept else pa.array([s[k] for s in told], kinds.field(k).type) for k in schema.names]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                yield part(rows)

    return df.mapInArrow(run, schema)
