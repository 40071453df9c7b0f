"""The rules: each maps a document, read once, to its findings.

They run over Arrow batches beside the post-passes, a document at a time, in time linear in it. A pattern is searched for only
in texts that hold a word it can't do without; those words are looked for in the text in lower case with its white space as
single spaces.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property, lru_cache
from operator import eq

from lectern.config import Config
from lectern.functions import text as T
from lectern.functions.lexicon import find, flattest_run
from lectern.functions.reading import Reading, grade, pattern, variation
from lectern.functions.tables import CONNECTORS, MARKS, RHYTHM, TARGETS, phrases
from lectern.operators import patterns as P
from lectern.operators.registry import ENTRIES

#: lists that a code reads
LISTS = {"NB303": "qualifier", "NB401": "complex", "NB315": "terminology", "NB502": "puffery", "NB503": "editorializing", "NB504": "filler", "NB505": "transition", "NB510": "intensifier", "NB517": "praise", "NB308": "presupposition", "NB316": "authority"}
WS = T.WS
_SPACES = re.compile(f"[{WS}]+")


def flat(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def decimals(x: float, digits: int) -> str:
    """Rounded half up by the shortest decimal form, as Java's format does."""
    return str(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


class Document(Reading):
    """A text with its original and marks, and what rules share."""

    def __init__(self, original: str, analysis: str, marks: list[dict], name: str | None, kind: str, c: Config):
        super().__init__(analysis, c.target)
        self.original, self.all_marks, self.name, self.kind, self.c = original, marks, name, kind, c

    @cached_property
    def low(self) -> str:
        return " ".join(self.text.lower().split())

    @cached_property
    def starts(self) -> set[int]:
        return {s.start for s in self.sentences}

    @cached_property
    def hits(self) -> dict[str, list[tuple]]:
        codes, out = self.c.reported(), {}
        for h in find(self.text, _lists(frozenset(codes)), self.c.backend == "lexical") if self.text else ():
            out.setdefault(h[0], []).append(h[1:])
        return out

    @cached_property
    def _para_starts(self) -> list[int]:
        return [a for a, _ in self.paragraphs]

    def paragraph_of(self, at: int) -> int:
        """From 1; 0 if an offset stands in none."""
        i = bisect_right(self._para_starts, at)
        return i if i and at < self.paragraphs[i - 1][1] else 0

    def marks(self, *kinds: str) -> list[dict]:
        return [m for m in self.all_marks if m["kind"] in kinds]

    def raw(self, m: dict) -> str:
        return self.original[m["start"] : m["end"]]

    def cased(self, words: str, at: int) -> str:
        """Capitalised where it opens a sentence."""
        return words[:1].upper() + words[1:] if at in self.starts else words

    def safe_to_cut(self, h: tuple) -> bool:
        return h[1] not in self.starts and h[3] not in CUT_MARKS and h[4] not in CUT_MARKS

    def in_code(self, at: int) -> bool:
        """Whether the markup pass blanked what stands there."""
        return self.original[at : at + 1] not in BLANK and self.text[at : at + 1] == " "

    def spans(self, rx: str, *needs: str) -> list[tuple[int, int, str]]:
        """(start, end, text) of all matches; none if the text lacks all of the words needed."""
        if needs and not any(n in self.low for n in needs):
            return []
        return [(*m.span(), m[0]) for m in pattern(rx).finditer(self.text)]

    def raw_spans(self, rx: str) -> list[tuple[int, int, str]]:
        return [(*m.span(), m[0]) for m in pattern(rx).finditer(self.original)]

    def issue(self, code: str, start: int, end: int, message: str, severity: str = "warning", suggestion: str | None = None, applicability: str = "replace", text: str | None = None) -> dict:
        """One finding. Without a suggestion it is advisory; an empty suggestion means to delete."""
        return {"code": code, "name": ENTRIES[code].name, "message": message, "severity": severity, "suggestion": suggestion, "applicability": "advisory" if suggestion is None else applicability, "text": self.text[start:end] if text is None else text, "start": start, "end": end}

    def whole(self, code: str, message: str, severity: str = "info") -> dict:
        return self.issue(code, 0, 0, message, severity, text="")


CUT_MARKS = {",", ";", ":", "—", "–", "(", ")", "-"}
BLANK = {" ", "\t", "\n", "\r", "\f", "\x0b"}


@lru_cache(None)
def _lists(codes: frozenset[str]) -> tuple[str, ...]:
    return tuple(sorted({LISTS[x] for x in codes if x in LISTS}))


@lru_cache(None)
def listed(name: str) -> dict[str, dict]:
    return {p.lower(): r for p, r in phrases(name).items()}


def alternatives(d: Document, name: str, h: tuple) -> str | None:
    """Alternatives of a phrase, each cased for its place and joined; null if it has none."""
    found = listed(name).get(h[0], {}).get("alternatives")
    return ", ".join(d.cased(a, h[1]) for a in found) if found else None


# -- readability and words


def hard_sentences(d: Document) -> Iterator[dict]:
    few, hard, very = TARGETS[d.target]
    codes = d.c.reported()
    for s in d.some:
        if s.n >= few and (g := grade(s.letters, s.n, 1)) >= hard:
            code, says = ("NB201", "very hard to read") if g >= very else ("NB202", "hard to read")
            if code in codes:
                yield d.issue(code, s.start, s.end, f"{says}: grade {g}", text=s.text)


LY_END, LY_CHAR = re.compile(r"[lL][yY]['-]{0,4}(?![\w'-])"), re.compile(r"[\w'-]")


def adverbs_classic(d: Document) -> Iterator[dict]:
    skip = phrases("adverb_exception")
    for m in LY_END.finditer(d.text) if "ly" in d.low else ():
        start = m.start()
        while start and LY_CHAR.match(d.text, start - 1):
            start -= 1
        run = d.text[start : m.end()]
        start, end = start + len(run) - len(run.lstrip("'-")), m.end() - (len(run) - len(run.rstrip("'-")))
        if end - start > 3 and d.text[start:end].lower() not in skip:
            yield d.issue("NB301", start, end, f"adverb '{d.text[start:end]}' (surface rule): cut it or find a stronger verb")


PASSIVE_WORD = re.compile(rf"(?i)\A{P.S}[a-z]+{P.S}([a-z]+)", re.A)


def passives_classic(d: Document) -> Iterator[dict]:
    irregular = phrases("participle")
    for start, end, text in d.spans(P.CLASSIC_PASSIVE):
        word = PASSIVE_WORD.match(text)[1].lower()
        if word.endswith("ed") or word in irregular:
            yield d.issue("NB302", start + 1, end, f"passive '{text[1:]}' (surface rule): name who acts", text=d.text[start + 1 : end])


def qualifiers(d: Document) -> Iterator[dict]:
    for h in d.hits.get("qualifier", ()):
        row = listed("qualifier")[h[0]]
        if row["fix"] == "rewrite":
            fix, how = row["alternatives"][0], "rewrite"
        elif row["fix"] == "replace":
            fix, how = d.cased(row["alternatives"][0], h[1]), "replace"
        else:
            fix, how = ("", "replace") if d.safe_to_cut(h) else ("cut the hedge and keep the claim", "rewrite")
        yield d.issue("NB303", h[1], h[2], f"qualifier '{d.text[h[1] : h[2]]}' weakens the statement", suggestion=fix, applicability=how)


TWICE = re.compile(rf"(?<!\w)(?<!\w['’-])([^\W\d_]++)(?:[{WS}]++\1(?!\w|['’-]\w))+", re.I)


def repeated_words(d: Document) -> Iterator[dict]:
    w = d.lowered
    if not any(map(eq, w, w[1:])):
        return
    for m in TWICE.finditer(d.text):
        words = _SPACES.split(m[0])
        if m[1].isalpha() and len(words) == 2 and words[0].lower() not in ("had", "that"):
            yield d.issue("NB306", *m.span(), f"repeated word '{flat(m[0])}'", suggestion=words[0])


_STRONG = "very quite extremely somewhat rather really incredibly remarkably fairly pretty hugely tremendously"
_HARD, _SOFT = "unique perfect impossible infinite eternal unanimous identical inevitable irrevocable unprecedented", "essential universal ideal ultimate absolute"
UNCOMPARABLE = rf"(?i){P.opens('mlvqesritfph')}{T.LEFT}(?:{P.any_of('more most less least ' + _STRONG)} {P.any_of(_HARD)}|{P.any_of(_STRONG)} {P.any_of(_SOFT)}){T.RIGHT}"


def uncomparables(d: Document) -> Iterator[dict]:
    """Degree word and absolute adjective side by side; the adjective is known by its form alone."""
    for start, end, text in d.spans(UNCOMPARABLE, *f"{_HARD} {_SOFT}".split()):
        last = text.rpartition(" ")[2]
        yield d.issue("NB307", start, end, f"no degrees of '{last}'", suggestion=last[:1].upper() + last[1:].lower() if start in d.starts else last)


def condescending(d: Document) -> Iterator[dict]:
    for h in d.hits.get("presupposition", ()):
        fix, how = ("", "replace") if d.safe_to_cut(h) else ("cut it", "rewrite")
        yield d.issue("NB308", h[1], h[2], f"condescending: '{d.text[h[1] : h[2]]}'", suggestion=fix, applicability=how)


BRACKETED, NAME = re.compile(r"\(([^)]{2,120})\)"), rf"{P.L}([A-Z]{{2,6}})s?{P.R}"


@lru_cache(4)
def _allowed(known: tuple[str, ...], norms: frozenset[str]) -> frozenset[str]:
    return frozenset({*phrases("acronym"), *(a.upper() for a in known), *(w.upper() for w in norms if 2 <= len(w) <= 6)})


def acronyms(d: Document) -> Iterator[dict]:
    """First use of each acronym that nothing expands; needs the user's list of English words."""
    found = d.spans(rf"{T.LEFT}[A-Z]{{2,6}}{T.RIGHT}")
    if not found:
        return
    closed = {*pattern(NAME).findall(" | ".join(BRACKETED.findall(d.text))), *pattern(rf"{NAME}(?=[^(]{{0,10}}\([^)]{{2,120}}\))").findall(d.text)}
    closed |= {*pattern(rf"(?<=\n|\A)[{WS}>*_-]*([A-Z]{{2,6}})\**{P.S}*[—–:-]{P.S}*[^{WS}]").findall(d.text)} | _allowed(d.c.known_acronyms, d.c.norms)
    lowered = {w.lower() for w in d.words if w.isalpha() and w != w.upper()}
    firsts: dict[str, tuple] = {}
    for m in found:
        firsts.setdefault(m[2], m)
    for n, m in firsts.items():
        if n not in closed and n.lower() not in lowered:
            yield d.issue("NB309", m[0], m[1], f"'{n}' is never expanded", "info")


def terms(d: Document) -> Iterator[dict]:
    for h in d.hits.get("terminology", ()):
        yield d.issue("NB315", h[1], h[2], f"exclusionary term '{d.text[h[1] : h[2]]}'", suggestion=alternatives(d, "terminology", h))


def authority(d: Document) -> Iterator[dict]:
    """Fixed phrases, outside paragraphs that hold a source."""
    found = d.hits.get("authority", ())
    sourced = {d.paragraph_of(m["start"]) for m in d.marks("link-url", "url", "citation", "ref-def")} - {0} if found else ()
    for h in found:
        if d.paragraph_of(h[1]) not in sourced:
            yield d.issue("NB316", h[1], h[2], f"attributed to nobody: '{d.text[h[1] : h[2]]}'", listed("authority")[h[0]]["fix"], "name the source, or make the claim in your own voice", "rewrite")


def hidden(d: Document) -> Iterator[dict]:
    if d.original.isascii():
        return
    for start, end, text in d.raw_spans(P.HIDDEN):
        yield d.issue("NB317", start, end, f"invisible character U+{ord(text):04X}", suggestion="", text=text)
    for start, end, text in d.raw_spans(P.LOOKALIKE):
        yield d.issue("NB317", start, end, f"look-alike character in '{text}'", suggestion="retype the word in a single alphabet", applicability="rewrite", text=text)


def complex_phrases(d: Document) -> Iterator[dict]:
    for h in d.hits.get("complex", ()):
        yield d.issue("NB401", h[1], h[2], f"wordy: '{flat(d.text[h[1] : h[2]])}'", suggestion=alternatives(d, "complex", h))


# -- markup


def images(d: Document) -> Iterator[dict]:
    alts = d.marks("image-alt")
    for m in d.marks("image"):
        alt = next((a for a in alts if m["start"] <= a["start"] <= m["end"]), None)
        if alt is not None and flat(d.raw(alt)) == "":
            yield d.issue("NB311", m["start"], m["end"], "image without alternative text", "info", text=d.raw(m))


LINK_EDGE = re.compile(r"\A[\s*_`~]+|[\s*_`~.,;:!?]+\Z", re.A)


def links(d: Document) -> Iterator[dict]:
    urls = d.marks("link-url")
    starts = [u["start"] for u in urls]
    for m in d.marks("link-text"):
        if flat(LINK_EDGE.sub("", d.raw(m))).lower() in P.VAGUE_LINKS:
            i = bisect_right(starts, m["end"] - 1)
            where = f" to {d.raw(urls[i])}" if i < len(urls) and urls[i]["start"] - m["end"] <= 3 else ""
            yield d.issue("NB312", m["start"], m["end"], f"vague link text '{d.raw(m)}'{where}", suggestion="say in the link's words where it goes", applicability="rewrite", text=d.raw(m))


def heading_marks(d: Document) -> Iterator[dict]:
    for m in d.marks("heading"):
        trimmed = d.raw(m).rstrip("".join(BLANK))
        if trimmed.endswith((".", ",", ";", ":")) and not trimmed.endswith("..."):
            end = m["start"] + len(trimmed)
            yield d.issue("NB313", end - 1, end, f"heading ends in '{trimmed[-1]}'", "info", suggestion="", text=trimmed[-1])


README, PROSE = re.compile(r"(^|[\\/])readme(\.[a-z]+)?\Z"), re.compile(rf"\A[{WS}]*(?:[^{WS}]+[{WS}]+){{4}}[^{WS}]")


def readme(d: Document) -> Iterator[dict]:
    if d.kind != "markdown" or not README.search((d.name or "").lower()):
        return
    markers = d.marks("heading-marker")
    text = d.text
    # headings are blanked, then a line of five words says what the project is
    for m in d.marks("heading"):
        text = text[: m["start"]] + re.sub(r"[^\n]", " ", text[m["start"] : m["end"]]) + text[m["end"] :]
    text = text[: markers[2]["start"] if len(markers) > 2 else len(text)]
    if not any(PROSE.search(x) and any(ch.isalpha() for ch in x) for x in text.split("\n")):
        yield d.issue("NB801", 0, 0, "the README never says what the project is", "warning", "one sentence: what it is, and for whom", "rewrite", "")


# -- signs of machine writing

_NT = [f"{v}{n}" for v in ("is", "are", "was", "were") for n in ("nt", "n't")]
#: words without which a shape can't be, in the order of the shapes; all of the groups are needed
NEEDS = [[["not only"]], [["not just"]], [["s not"]], [_NT], [[",no", ", no"]], [[*_NT, "is not", "are not"], [" real", " actual", " true"]], [["s not"]]]
NEEDS_ADVISORY = [[["no longer"]], [["mean"]], [["feel", "seem", "look", "sound"]], [["more than just"]], [["need to", "have to"], ["its ", "their "]]]


def negation(d: Document) -> Iterator[dict]:
    """All shapes in order; a match that overlaps an accepted one is dropped."""
    kept: list[tuple[int, int]] = []
    for level, shapes, needs in (("warning", P.NEGATION, NEEDS), ("info", P.NEGATION_ADVISORY, NEEDS_ADVISORY)):
        for rx, groups in zip(shapes, needs):
            if all(any(n in d.low for n in g) for g in groups):
                for start, end, text in d.spans(rx):
                    if not any(start < b and a < end for a, b in kept):
                        kept.append((start, end))
                        bare = text.strip(" ")
                        yield d.issue("NB501", start, end, f"negation and contrast: '{bare}'", level, text=bare)


def em_dashes(d: Document) -> Iterator[dict]:
    found = d.spans(P.EM_DASH, "—", "–", " - ")
    if len(found) >= 3 and d.n_words > 0 and len(found) * 1000 >= d.n_words * 12:
        yield d.issue("NB506", *found[0][:2], f"{len(found)} em dashes in {d.n_words} words", text=found[0][2])


def emoji(d: Document) -> Iterator[dict]:
    found = [] if d.text.isascii() else d.spans(P.EMOJI)
    if len(found) >= 3:
        yield d.issue("NB508", *found[0][:2], f"{len(found)} emoji as formatting", text=found[0][2])


def phrase_rule(code: str, says: str, severity: str = "warning", cut: bool = False) -> Callable[[Document], Iterator[dict]]:
    def rule(d: Document) -> Iterator[dict]:
        for h in d.hits.get(LISTS[code], ()):
            fix, how = (None, "") if not cut else ("", "replace") if d.safe_to_cut(h) else ("cut it", "rewrite")
            yield d.issue(code, h[1], h[2], f"{says} '{d.text[h[1] : h[2]]}'", severity, fix, how)

    return rule


def puffery(d: Document) -> Iterator[dict]:
    """Words used often enough to be the topic are advisory. The senses that need a parser are left out."""
    found = [h for h in d.hits.get("puffery", ()) if h[0] not in phrases("puffery_sense")]
    often = 3 if d.n_words >= 1000 else 2
    n = Counter(h[0] for h in found)
    for h in found:
        text = d.text[h[1] : h[2]]
        yield d.issue("NB502", h[1], h[2], f"puffery '{text}'", "info" if n[h[0]] >= often else "warning", alternatives(d, "puffery", h), "replace" if text.lower() == h[0] else "rewrite")


def praise(d: Document) -> Iterator[dict]:
    found = d.hits.get("praise", ())
    kinds: dict[int, set[str]] = {}
    for h in found:
        kinds.setdefault(d.paragraph_of(h[1]), set()).add(h[0])
    for h in found:
        if len(kinds[d.paragraph_of(h[1])]) >= 2:
            yield d.issue("NB517", h[1], h[2], f"generic praise '{d.text[h[1] : h[2]]}' among more of it", "info")


def rhythm(d: Document) -> Iterator[dict]:
    least, flat_ = RHYTHM[d.target]
    if len(d.some) >= 6 and d.burstiness < least:
        run = flattest_run(d.lengths)
        start, end = (d.some[run[0]].start, d.some[run[1] - 1].end) if run else (0, 0)
        yield d.issue("NB509", start, end, f"monotonous rhythm: variation {decimals(d.burstiness, 2)}, aim for {decimals(least, 2)}", "warning" if d.burstiness < flat_ else "info", text="")


def pattern_rule(code: str, rx: str, says: str, *needs: str) -> Callable[[Document], Iterator[dict]]:
    def rule(d: Document) -> Iterator[dict]:
        for start, end, text in d.spans(rx, *needs):
            yield d.issue(code, start, end, f"{says} '{flat(text)}'", "info")

    return rule


def openers(d: Document) -> Iterator[dict]:
    """Runs of three and more sentences that open with the same word."""
    w = [s.words[0].lower() if s.words else "" for s in d.sentences]
    i = 0
    for j in range(1, len(w) + 1):
        if j == len(w) or w[j] != w[i]:
            if j - i >= 3 and w[i]:
                start, end = d.sentences[i].start, d.sentences[j - 1].end
                yield d.issue("NB512", start, end, f"{j - i} sentences in a row open with '{w[i]}'", "info", text=d.text[start:end][:80])
            i = j


def curly(d: Document) -> Iterator[dict]:
    found = [] if d.text.isascii() else d.spans(P.CURLY)
    if found and len(found) < d.text.count('"') + d.text.count("'"):
        for start, end, text in found:
            yield d.issue("NB513", start, end, f"curly quote '{text}' among straight ones", "info")


HEADING_LEAD, HEADING_TAIL = re.compile(r"\A#{1,6}[ \t]+"), re.compile(r"[ \t]*#*\Z")


def headings(d: Document) -> list[tuple[int, int, str]]:
    """Headings of the original text, outside code: the span of their words."""
    out = []
    for start, _, text in d.raw_spans(P.HEADING) if "#" in d.original else ():
        lead = HEADING_LEAD.match(text).end()
        body = HEADING_TAIL.sub("", text[lead:])
        if not d.in_code(start + lead):
            out.append((start + lead, start + lead + len(body), body))
    return out


def title_case(d: Document) -> Iterator[dict]:
    for start, end, text in headings(d):
        if any(w.lower() in P.HEADING_WORDS and unicodedata.category(w[0]) == "Lu" for w in flat(text).split(" ")[1:] if w):
            yield d.issue("NB514", start, end, f"title case in heading '{text}'", "info", text=text)


CONTRAST = P.CONTRAST.replace(r".*\z", r"[^\n\r\u0085\u2028\u2029]*\z")


def contrast_headings(d: Document) -> Iterator[dict]:
    found = [h for h in headings(d) if pattern(CONTRAST).search(h[2])]
    for start, end, text in found:
        yield d.issue("NB524", start, end, f"contrast in heading '{text}'", "warning" if len(found) >= 2 else "info", text=text)


HYPHEN_TAIL = re.compile(r"[^ \t\n\r\f\x0b]+\Z")


def hyphens(d: Document) -> Iterator[dict]:
    for _, end, text in d.spans(P.HYPHEN, *(w + "-" for w in "cross client data decision well high real long end cutting state full self user feature first second third multi non open closed".split())):
        tail = HYPHEN_TAIL.search(text)[0]
        yield d.issue("NB515", end - len(tail), end, f"no hyphen after a verb: '{tail}'", "info", suggestion=tail.replace("-", " "))


def bold_lists(d: Document) -> Iterator[dict]:
    if "**" not in d.original:
        return
    at_stars = lambda rx: [(s + t.index("**"), e, t[t.index("**") :]) for s, e, t in d.raw_spans(rx) if not d.in_code(s + t.index("**") + 2)]
    found = at_stars(P.BOLD)
    if len(found) >= 3:
        yield d.issue("NB516", *found[0][:2], f"{len(found)} bold labels", "info", text=found[0][2])
    for start, end, text in at_stars(P.BOLD_PERIOD):
        yield d.issue("NB516", start, end, f"bold label ends in a period: '{text}'", "info", text=text)


TOOL_NEEDS = {"chat citation": ("citeturn", "oaicit", "oai_cit", "oaicite", "grok_", "attached_file", "ppl-ai", "span"), "tool address": ("referrer=", "utm_source="), "placeholder": ("[", "-XX-XX"), "cutoff": ("as of my", "my knowledge cutoff", "i do", "i don")}


def artifacts(d: Document) -> Iterator[dict]:
    for kind, rx in P.ARTIFACTS.items():
        within = d.original.lower() if kind == "cutoff" else d.original
        if any(n in within for n in TOOL_NEEDS[kind]):
            for start, end, text in d.raw_spans(rx):
                yield d.issue("NB519", start, end, f"left by a tool, {kind}: '{text}'", text=text)


def hedge_stacks(d: Document) -> Iterator[dict]:
    for start, end, text in d.spans(P.HEDGES, *"potentially eventually ultimately possibly perhaps conceivably".split()):
        yield d.issue("NB520", start, end, f"stacked hedge '{text}'", suggestion=flat(text).partition(" ")[0])


PARAGRAPH_START, ASCII_WORD = re.compile(rf"\n[ \t]*\n[ \t]*(?=[^{WS}])|\A{P.S}+(?=[^{WS}])"), re.compile(r"[A-Za-z']+")


def paragraph_openers(d: Document) -> Iterator[dict]:
    placed = []
    for m in PARAGRAPH_START.finditer("\n" + d.text):
        if w := ASCII_WORD.match(d.text, m.end() - 1, m.end() + 63):
            placed.append((*w.span(), w[0].lower()))
    n = Counter(w for _, _, w in placed)
    for start, end, w in placed:
        if w in ("and", "but", "so", "yet", "or") and n[w] >= 3 and n[w] * 10 >= len(placed):
            yield d.issue("NB521", start, end, f"{n[w]} paragraphs open with '{w}'")


def bait(d: Document) -> Iterator[dict]:
    text = d.text.rstrip("".join(BLANK))
    if text.endswith("?") and (m := pattern(P.BAIT).search(text.rpartition("\n\n")[2])):
        yield d.issue("NB522", len(text) - len(m[1]), len(text), f"engagement bait '{m[1]}'", "info", text=m[1])


def uniform_paragraphs(d: Document) -> Iterator[dict]:
    n = [len(p) for p in d.by_paragraph(3) if p]
    if len(n) >= 6 and sum(n) >= 2 * len(n) and variation(n) < 0.35:
        yield d.whole("NB527", f"{len(n)} paragraphs of like length")


def diversity(d: Document) -> Iterator[dict]:
    if d.n_alpha >= 120 and d.mattr < 0.55:
        yield d.whole("NB528", f"narrow vocabulary: {decimals(d.mattr, 2)}, aim for 0.55", "warning" if d.mattr < 0.45 else "info")


def punchlines(d: Document) -> Iterator[dict]:
    full = [p for p in d.by_paragraph(1) if p]
    short = [p[-1] for p in full if p[-1].n <= 8]
    if len(full) >= 6 and sum(map(len, full)) >= 2 * len(full) and len(short) >= 3 and len(short) * 2 >= len(full):
        one = short[0]
        yield d.issue("NB529", one.start, one.end, f"{len(short)} of {len(full)} paragraphs end on a punchline", "info", text=one.text[:80])


BOLTED_NEEDS = ("reminded", "made me", "got me", "brought to", "took me", "recently", "speaking of")


def bolted(d: Document) -> Iterator[dict]:
    for a, b in d.paragraphs if any(n in d.low for n in BOLTED_NEEDS) else ():
        text = d.text[a:b]
        if m := pattern(P.BOLTED).match(text):
            start = a + len(text) - len(text.lstrip("".join(BLANK)))
            if a + m.end() > start:
                yield d.issue("NB531", start, a + m.end(), f"bolted-on connector '{flat(d.text[start : a + m.end()])}'", "info")


# -- style drift


def connectors(d: Document) -> Iterator[dict]:
    profile = d.c.style
    if not profile or profile["corpus"]["sentences"] < 300:
        return
    usual = dict(profile["connectors_per_1000_sentences"])
    for s in d.some:
        one, two = s.words[0].lower(), " ".join(s.words[:2]).lower()
        hit = next((k for k in CONNECTORS if k in (one, two)), None)
        if hit is not None and usual.get(hit, 0.0) < 1.0:
            at = s.text.find(s.words[0])
            end = at + len(s.words[0])
            if " " in hit:  # the second word begins after the first; what lies between is not measured twice
                end = s.text.find(s.words[1], end) + len(s.words[1])
            yield d.issue("NB701", s.start + at, s.start + end, f"'{hit}' opens a sentence, unlike {profile['name']}", "info")


def drift(d: Document) -> Iterator[dict]:
    profile = d.c.style
    if not profile or profile["corpus"]["words"] < 5000:
        return
    r = profile["rhythm"]
    low = [mine < 0.65 * theirs for mine, theirs in ((d.burstiness, r["sentence_cv"]), (d.seg_burstiness, r["segment_cv"])) if theirs]
    if len(d.some) >= 6 and any(low):
        yield d.whole("NB702", f"rhythm flatter than {profile['name']}'s: sentences {decimals(d.burstiness, 2)}, segments {decimals(d.seg_burstiness, 2)}")


def punctuation(d: Document) -> Iterator[dict]:
    profile = d.c.style
    if not profile or profile["corpus"]["words"] < 5000 or not d.n_words:
        return
    out = []
    for name, mark in MARKS.items():
        usual, n = profile["punctuation_per_1000_words"].get(name, 0.0), d.text.count(mark)
        rate = n * 1000.0 / d.n_words
        if n >= 3 and rate >= 3.0 * max(usual, 0.1) and rate - usual >= 1.0:
            out.append(d.whole("NB703", f"{name.replace('_', ' ')} {n} times, {decimals(rate, 1)} a 1000 words, usually {usual:.1f}"))
    yield from out[:3]


def authorship(d: Document) -> Iterator[dict]:
    """Mean distance of a document's function-word rates from the author's, in the author's deviations; none below 300 words."""
    profile = d.c.style
    if not profile or not profile.get("delta") or d.n_words < 300:
        return
    stats, n = profile["delta"]["words"], Counter(d.alpha)
    delta = sum(abs((n[w] * 1000.0 / d.n_words - float(mean)) / float(std)) for w, (mean, std) in stats.items()) / float(len(stats))
    if delta > 1.1:
        yield d.whole("NB704", f"far from {profile['name']}: function-word distance {decimals(delta, 2)}")


RULES: dict[tuple[str, ...], Callable[[Document], Iterator[dict]]] = {
    ("NB201", "NB202"): hard_sentences, ("NB301",): adverbs_classic, ("NB302",): passives_classic, ("NB401",): complex_phrases, ("NB303",): qualifiers, ("NB306",): repeated_words, ("NB307",): uncomparables, ("NB308",): condescending,
    ("NB311",): images, ("NB312",): links, ("NB313",): heading_marks, ("NB801",): readme, ("NB316",): authority, ("NB317",): hidden, ("NB315",): terms, ("NB309",): acronyms,
    ("NB501",): negation, ("NB502",): puffery, ("NB503",): phrase_rule("NB503", "editorializing", "info"), ("NB504",): phrase_rule("NB504", "filler"), ("NB505",): phrase_rule("NB505", "overused transition", "info", cut=True), ("NB506",): em_dashes, ("NB508",): emoji,
    ("NB510",): phrase_rule("NB510", "weak intensifier", "info", cut=True), ("NB511",): pattern_rule("NB511", P.CLOSER, "empty closer", *"highlighting underscoring emphasi reflecting showcasing symboli demonstrating illustrating signal marking cementing solidifying reinforcing showing affirming".split()), ("NB509",): rhythm, ("NB512",): openers, ("NB513",): curly, ("NB514",): title_case, ("NB515",): hyphens, ("NB516",): bold_lists, ("NB517",): praise, ("NB519",): artifacts,
    ("NB520",): hedge_stacks, ("NB521",): paragraph_openers, ("NB522",): bait, ("NB523",): pattern_rule("NB523", P.ANAPHORA, "triad with one opening word", *"more less fewer every each".split()), ("NB524",): contrast_headings, ("NB527",): uniform_paragraphs, ("NB528",): diversity, ("NB529",): punchlines, ("NB531",): bolted,
    ("NB532",): pattern_rule("NB532", P.UNITY, "unity asserted, not shown", " like", "the same", " one "), ("NB701",): connectors, ("NB702",): drift, ("NB703",): punctuation, ("NB704",): authorship,
}

NEEDS_VOCABULARY = {"NB528"}


@lru_cache(8)
def _running(codes: frozenset[str], norms: bool) -> tuple[Callable, ...]:
    return tuple(rule for group, rule in RULES.items() if codes & set(group) and (norms or group != ("NB309",)))


def found(d: Document, codes: frozenset[str]) -> list[dict]:
    """The findings of all enabled rules, in their order."""
    return [f for rule in _running(codes, d.c.norms is not None) for f in rule(d)]
