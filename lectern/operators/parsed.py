"""Rules and statistics over a parse that the user brings: lemma, part of speech, dependency and head of each token.

There is no tagger here. A column of the documents holds the tokens of each text in order (``TOKENS``): offsets of the
original text, universal part of speech, dependency label, ``head`` as a place in the array (its own for a root), and whether
a sentence starts at the token. Everything is linear in the tokens of one document, and runs with the post-passes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from lectern.functions.tables import phrases
from lectern.operators.registry import ENTRIES

TOKENS = "array<struct<start:int,end:int,lemma:string,pos:string,dep:string,head:int,sent:boolean,stop:boolean>>"
STATISTICS = ("nominal_density", "pronoun_density", "paragraph_cohesion", "dependency_distance", "formality", "modifier_density")
VERBAL, NOMINAL, CONTENT = {"VERB", "AUX"}, {"NOUN", "PROPN", "PRON", "NUM"}, {"NOUN", "PROPN", "VERB", "ADJ", "ADV"}
LEAD, SHORT, RATED = 20, 4, 12  # words before the root; words of a fragment; rated words of a paragraph
ABSTRACT, PAIR = 2.2, 3.0  # mean rating of an abstract paragraph or the lesser of a range; mean of a range
REPLACED = {"above": "preceding", "below": "following"}
THROUGH = {"come": "to", "arrive": "at"}
ITEM = re.compile(r"^[ \t]*(?:[-*+•]|[0-9]+[.)])[ \t]+", re.M)
REVEAL = re.compile(r"\b(?:is|are|was|were)[ \t\n]*:[ \t\n]*\Z")
MODIFIES = {"amod", "det", "poss", "compound", "nummod", "nmod", "prep", "acl", "relcl", "appos"}
FORMAL, DEICTIC = {"NOUN", "PROPN", "ADJ", "ADP"}, {"PRON", "VERB", "AUX", "ADV", "INTJ"}


@dataclass
class Token:
    i: int
    start: int
    end: int
    text: str
    lemma: str
    pos: str
    dep: str
    head: int
    stop: bool
    sentence: int = 0
    children: list[int] = field(default_factory=list)

    @property
    def word(self) -> bool:
        return self.pos not in ("PUNCT", "SPACE")


class Parse:
    def __init__(self, text: str, tokens: list[dict]):
        self.text, self.tokens, self.bounds = text, [], []
        for i, t in enumerate(tokens):
            if t["sent"] or i == 0:
                self.bounds.append(i)
            head = t["head"] if t["head"] is not None and 0 <= t["head"] < len(tokens) else i
            surface = text[t["start"] : t["end"]]
            self.tokens.append(Token(i, t["start"], t["end"], surface, (t["lemma"] or surface).lower(), t["pos"] or "", t["dep"] or "", head, bool(t["stop"]), len(self.bounds) - 1))
        for t in self.tokens:
            if t.head != t.i:
                self.tokens[t.head].children.append(t.i)
        self.sentences = [self.tokens[a:b] for a, b in zip(self.bounds, [*self.bounds[1:], len(self.tokens)])]

    def head(self, t: Token) -> Token:
        return self.tokens[t.head]

    def kids(self, t: Token) -> list[Token]:
        return [self.tokens[i] for i in t.children]

    def span(self, sentence: list[Token]) -> tuple[int, int]:
        """A sentence without the white space after it."""
        start, end = sentence[0].start, sentence[-1].end
        return start, start + len(self.text[start:end].rstrip())

    def root(self, sentence: list[Token]) -> Token:
        return next((t for t in sentence if t.head == t.i), sentence[0])

    def words(self) -> list[Token]:
        return [t for t in self.tokens if t.word]


def flat(s: str) -> str:
    return " ".join(s.split())


def finding(p: Parse, code: str, start: int, end: int, message: str, severity: str = "info", suggestion: str | None = None, how: str = "advisory") -> dict:
    return {"code": code, "name": ENTRIES[code].name, "message": message, "severity": severity, "suggestion": suggestion, "applicability": how, "text": p.text[start:end], "start": start, "end": end}


def periodic(p: Parse, **_) -> Iterator[dict]:
    for s in p.sentences:
        root = p.root(s)
        before = sum(t.word for t in s if t.i < root.i)
        if root.pos in VERBAL and before > LEAD:
            yield finding(p, "NB203", *p.span(s), f"{before} words stand before the main verb: open with the point, or split here")


def nominalizations(p: Parse, **_) -> Iterator[dict]:
    verbs, light = phrases("nominalization"), phrases("light_verb")
    for t in p.tokens:
        if t.lemma not in verbs:
            continue
        head = p.head(t)
        if t.dep == "pobj" and THROUGH.get(p.head(head).lemma) == head.lemma:
            head = p.head(head)
        elif not (t.dep in ("dobj", "obj") and head.lemma in light):
            continue
        start, end = min(head.start, t.start), max(head.end, t.end)
        row = verbs[t.lemma]
        yield finding(p, "NB304", start, end, f"action in a noun, '{flat(p.text[start:end])}': use the verb", "warning", row["alternatives"][0] if row["alternatives"] else row["fix"], "rewrite")


def dummy_subjects(p: Parse, **_) -> Iterator[dict]:
    for t in p.tokens:
        if t.dep == "expl" and t.lemma == "there":
            head = p.head(t)
            start, end = min(t.start, head.start), max(t.end, head.end)
            yield finding(p, "NB305", start, end, f"empty subject '{flat(p.text[start:end])}': name the real one first", "warning")


def directions(p: Parse, **_) -> Iterator[dict]:
    nouns, verbs = phrases("document_noun"), phrases("reference_verb")
    last = None  # the token before, other than white space
    for t in p.tokens:
        before, last = last, last if t.pos == "SPACE" else t
        word = REPLACED.get(t.text.lower())
        if word is None or any(k.pos in NOMINAL for k in p.kids(t)):
            continue
        says = "place on the page: '{}'"
        if before is not None and before.lemma in nouns:
            det = next((k for k in p.kids(before) if k.dep == "det" and k.i == before.i - 1), None)
            message = says.format(f"{before.text} {t.text}")
            if det is None:
                yield finding(p, "NB310", t.start, t.end, message, "info", f"the {word} {before.text}", "rewrite")
            else:
                phrase = f"{det.text} {word} {before.text}"
                yield finding(p, "NB310", det.start, t.end, message, "info", phrase, "replace")
        elif p.head(t).pos in VERBAL and p.head(t).lemma in verbs:
            yield finding(p, "NB310", t.start, t.end, says.format(t.text), "info", "name or link the section: places move when text reflows", "rewrite")


def steps(p: Parse, original: str, kind: str, **_) -> Iterator[dict]:
    if kind != "markdown":
        return
    line_of = lambda at: original.count("\n", 0, at)
    items = {line_of(m.end()) for m in ITEM.finditer(original)}
    reader, modal = phrases("reader"), phrases("modal_lemma")
    for s in p.sentences if items else ():
        if line_of(s[0].start) not in items:
            continue
        subject = next((t for t in s[:2] if t.dep in ("nsubj", "nsubjpass") and t.lemma in reader and p.head(t).pos in VERBAL), None)
        if subject is None:
            continue
        verb = p.head(subject)
        if verb.lemma in modal:
            verb = next((k for k in p.kids(verb) if k.dep in ("xcomp", "ccomp")), verb)
        rest = " ".join(t.text for t in s if t.i > verb.i and t.pos != "PUNCT")
        yield finding(p, "NB314", subject.start, s[-1].end, "a step that names its reader: use the imperative", "info", f"{verb.lemma.capitalize()} {rest}".strip(), "rewrite")


def _verbless(p: Parse, s: list[Token]) -> bool:
    return not any(t.pos in VERBAL for t in s)


def staccato(p: Parse, **_) -> Iterator[dict]:
    newlines = [m.start() for m in re.finditer("\n", p.text)]
    line = lambda s: bisect_left(newlines, s[0].start)
    run: list[list[Token]] = []
    for s in [*p.sentences, None]:
        short = s is not None and 1 <= sum(t.word for t in s) <= SHORT and p.text[slice(*p.span(s))][-1:] in (".", "!", "?") and _verbless(p, s)
        if short and run and line(run[-1]) == line(s):
            run.append(s)
            continue
        if len(run) >= 3:
            yield finding(p, "NB507", run[0][0].start, p.span(run[-1])[1], f"{len(run)} fragments in a row")
        run = [s] if short else []


def triads(p: Parse, **_) -> Iterator[dict]:
    tokens = [t for t in p.tokens if t.pos != "SPACE"]
    content = ("ADJ", "NOUN", "VERB")
    found = []
    for k, a in enumerate(tokens[:-4] if len(tokens) > 4 else ()):
        if a.pos != "ADJ" or tokens[k + 1].text != "," or tokens[k + 2].pos not in content:
            continue
        rest = tokens[k + 3 : k + 6]
        rest = rest[1:] if rest[0].text == "," else rest
        if len(rest) < 2 or rest[0].pos != "CCONJ" or rest[1].pos not in content or rest[1].sentence != a.sentence:
            continue
        c = rest[1]
        before = p.tokens[a.i - 1] if a.i else None
        after = p.tokens[c.i + 1] if c.i + 1 < len(p.tokens) else None
        if not (before and (before.text == "," or before.pos == "CCONJ")) and not (after and after.text == ","):
            found.append((a.start, c.end))
    n = len(p.words())
    dense = len(found) >= 2 and len(found) * 1000 >= 1.5 * n
    for start, end in found:
        reveal = REVEAL.search(p.text[max(0, start - 40) : start])
        if dense or reveal:
            yield finding(p, "NB518", start, end, f"{'a triad after a colon' if reveal else 'triad of adjectives'}: '{flat(p.text[start:end])}'")


def hook_questions(p: Parse, **_) -> Iterator[dict]:
    asking = phrases("question_word")
    for s, answer in zip(p.sentences, p.sentences[1:]):
        start, stop = p.span(s)
        words = [t for t in s if t.word]
        if not p.text[start:stop].endswith("?") or not 2 <= len(words) <= SHORT or not _verbless(p, s) or any(t.text.lower() in asking for t in words):
            continue
        begin, end = p.span(answer)
        said = p.text[begin:end].strip()
        if said and not said.endswith("?") and "\n\n" not in p.text[stop:begin]:
            yield finding(p, "NB525", start, end, f"asks and answers itself: '{flat(p.text[start:end])}'")


def false_ranges(p: Parse, ratings: dict[str, float], **_) -> Iterator[dict]:
    motion = phrases("motion_verb")
    for t in p.tokens:
        if t.text.lower() != "from":
            continue
        s = p.sentences[t.sentence]
        limit = s[-1].i + 1
        to = next((x for x in p.tokens[t.i + 1 : min(t.i + 7, limit)] if x.text.lower() == "to"), None)
        if to is None or to.pos == "PART":
            continue
        x, y = p.tokens[t.i + 1 : to.i], []
        for u in p.tokens[to.i + 1 : min(to.i + 5, limit)]:
            if u.pos in ("PUNCT", "CCONJ", "SCONJ"):
                break
            y.append(u)
        if any(u.pos in ("NUM", "PROPN") for u in (*x, *y)):
            continue
        a, b = (next((u for u in reversed(side) if u.pos == "NOUN"), None) for side in (x, y))
        if a is None or b is None or (a.lemma, b.lemma) in (("time", "time"), ("strength", "strength")):
            continue
        head = p.head(t)
        if head.pos == "VERB" and head.lemma in motion or a.lemma not in ratings or b.lemma not in ratings:
            continue
        rates = ratings[a.lemma], ratings[b.lemma]
        if min(rates) < ABSTRACT and sum(rates) / 2 < PAIR:
            yield finding(p, "NB526", t.start, y[-1].end, f"no scale from '{a.text}' to '{b.text}'")


def fragments(p: Parse, **_) -> Iterator[dict]:
    sentences = [s for s in p.sentences if any(t.word for t in s)]
    cut = [s for s in sentences if p.root(s).pos not in VERBAL and p.text[slice(*p.span(s))].endswith((".", "!", "?", "…"))]
    if len(sentences) >= 8 and len(cut) >= 3 and len(cut) > 0.12 * len(sentences):
        yield finding(p, "NB530", *p.span(cut[0]), f"{len(cut)} of {len(sentences)} sentences have no verb")


def abstract_paragraphs(p: Parse, ratings: dict[str, float], paragraphs: list[tuple[int, int]], **_) -> Iterator[dict]:
    starts = [t.start for t in p.tokens]
    for start, end in paragraphs:
        inside = p.tokens[max(0, bisect_right(starts, start) - 1) : bisect_left(starts, end)]
        rates = [ratings[t.lemma] for t in inside if t.end > start and t.pos in ("NOUN", "VERB") and t.lemma in ratings]
        if len(rates) >= RATED and sum(rates) / len(rates) < ABSTRACT:
            stop = start + len(p.text[start:end].rstrip())
            yield finding(p, "NB601", start, stop, f"nothing to see or touch here (concreteness {sum(rates) / len(rates):.1f} of 5)")


RULES: dict[str, Callable[..., Iterator[dict]]] = {
    "NB203": periodic,
    "NB304": nominalizations,
    "NB305": dummy_subjects,
    "NB310": directions,
    "NB314": steps,
    "NB507": staccato,
    "NB518": triads,
    "NB525": hook_questions,
    "NB526": false_ranges,
    "NB530": fragments,
    "NB601": abstract_paragraphs,
}


def statistics(p: Parse, paragraphs: list[tuple[int, int]]) -> dict[str, float]:
    """Densities and distances by the parse; 0 where there is nothing to divide by."""
    share = lambda a, b: a / b if b else 0.0
    words = p.words()
    content = [t for t in p.tokens if t.pos in CONTENT]
    gaps = [abs(t.i - t.head) for t in words if t.head != t.i]
    formal = sum(t.pos in FORMAL or t.pos == "DET" and t.text.lower() in ("a", "an", "the") for t in words)
    deictic = sum(t.pos in DEICTIC for t in words)
    heads = [t for t in p.tokens if t.pos in ("NOUN", "PROPN") and t.dep != "compound"]
    starts = [t.start for t in p.tokens]
    kinds = []
    for start, end in paragraphs:
        inside = p.tokens[max(0, bisect_right(starts, start) - 1) : bisect_left(starts, end)]
        lemmas = {t.lemma for t in inside if t.end > start and t.pos in CONTENT and t.text.isalpha() and not t.stop}
        if len(lemmas) >= 5:
            kinds.append(lemmas)
    overlaps = [len(a & b) / min(len(a), len(b)) for a, b in zip(kinds, kinds[1:])]
    return {
        "nominal_density": share(sum(t.pos in ("NOUN", "PROPN") for t in content), len(content)),
        "pronoun_density": share(sum(t.pos == "PRON" for t in words), len(words)) * 100,
        "paragraph_cohesion": share(sum(overlaps), len(overlaps)),
        "dependency_distance": share(sum(gaps), len(gaps)),
        "formality": ((formal - deictic) / len(words) * 100 + 100) / 2 if words else 0.0,
        "modifier_density": share(sum(k.dep in MODIFIES for h in heads for k in p.kids(h)), len(heads)),
    }


def trigrams(p: Parse) -> dict[str, int]:
    """Counts of three parts of speech in a row, white space left out."""
    tags = [t.pos for t in p.tokens if t.pos != "SPACE"]
    out: dict[str, int] = {}
    for three in zip(tags, tags[1:], tags[2:]):
        out[" ".join(three)] = out.get(" ".join(three), 0) + 1
    return out


def parsed(text: str, tokens: list[dict], codes: set[str], original: str, kind: str, ratings: dict[str, float] | None) -> tuple[list[dict], dict[str, float]]:
    """Findings of the enabled rules and the statistics of one document. Rules that need ratings yield nothing without any."""
    p = Parse(text, tokens)
    paragraphs, at = [], 0
    for m in re.finditer(r"\n[ \t]*\n[ \t\n\r\f\v]*|\Z", text):
        if m.start() > at:
            paragraphs.append((at, m.start()))
        at = m.end()
    found = [f for code, rule in RULES.items() if code in codes for f in rule(p, original=original, kind=kind, ratings=ratings or {}, paragraphs=paragraphs)]
    return found, statistics(p, paragraphs)
