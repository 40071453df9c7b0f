"""Small texts of our own, with what the rules find in them.

Word lists and most patterns hardly occur in generated corpora, so queries over these texts stand beside those over
tables: (doc_id, kind, text), and for each the findings (code, start, end).
"""

from __future__ import annotations

import re

TEXTS: list[tuple[int, str, str]] = [
    (1, "text", "The the cat utilizes a number of things. It was written by John. This is very unique. Of course we can do it. Perhaps it works."),
    (2, "text", "It's not a bug, it's a feature. Not only fast but cheap. It could potentially work. The system is well-known. He left, highlighting the need for change. More speed, more power, more control."),
    (3, "markdown", "# A Title With The Case\n\n## Speed, not size.\n\n[click here](http://a.b) ![](x.png)\n\nAnd so it goes on here.\n\nAnd then again it did.\n\nAnd finally it ended.\n\n- **Label.** text\n"),
    (4, "text", "He ran. He sat. He ate. Delve into the robust tapestry. It's worth noting this. zero\u200bwidth p\u0430y"),
    (5, "text", "He said \"we utilize a number of tools\" and left. The word \"utilize\" is long. They had had enough. No no no, they said."),
    (6, "text", "The rollout feels fast. But it is not ready. This doesn't mean we failed. Sometimes it means we learned. One — two — three — four."),
    (7, "text", "That reminded me of home.\n\nSpeaking of trains, they run late.\n\nThese may sound like different problems, but they are the same. What's the best tool you have used?"),
    (8, "text", "The plan mixes \u2018curly\u2019 with \"straight\" and \"plain\" and 'single' marks. See oaicite? No: contentReference[oaicite:3]{index=3} and utm_source=chatgpt.com here."),
    (9, "html", "<p>Look at <img src='a.png'> and <img src='b.png' alt='a chart'> and the the <b>end</b>.</p>"),
    (10, "markdown", "Some text.\n\n> A number of quoted words here.\n\nA number of plain words. <!-- lectern: ignore NB401 -->\n\nA number of others."),
    (11, "text", ""),
    (12, "text", "Whitelist the host. The master/slave pair needs a sanity check. \U0001F600 \U0001F680 \U0001F525"),
]


def tokens_of(text: str, spec: str) -> list[tuple]:
    """Tokens of a small text: words and signs in order, each described as lemma/POS/dep/head, the head as a place in the text.
    A sentence starts after a full stop, question mark or newline."""
    out, opens = [], True
    for m, one in zip(re.finditer(r"\w+|[^\w\s]", text), spec.split(), strict=True):
        lemma, pos, dep, head = one.rsplit("/", 3)
        opens = opens or "\n" in text[out[-1][1] : m.start()]
        out.append((m.start(), m.end(), lemma, pos, dep, int(head), opens, lemma in ("the", "a", "it", "be", "of")))
        opens = m[0] in ".?!"
    return out


def _sentences(*parts: tuple[str, str], sep: str = " ") -> tuple[str, str]:
    """Texts and specs, each with heads of its own, joined."""
    text, spec, at = [], [], 0
    for t, s in parts:
        ones = [x.rsplit("/", 1) for x in s.split()]
        text.append(t)
        spec += [f"{a}/{int(h) + at}" for a, h in ones]
        at += len(ones)
    return sep.join(text), " ".join(spec)


_DECIDE = ("Users made a decision.", "user/NOUN/nsubj/1 make/VERB/ROOT/1 a/DET/det/3 decision/NOUN/dobj/1 ./PUNCT/punct/1")
_THERE = ("There are many resorts.", "there/PRON/expl/1 be/AUX/ROOT/1 many/ADJ/amod/3 resort/NOUN/attr/1 ./PUNCT/punct/1")
_TABLE = ("See the table below.", "see/VERB/ROOT/0 the/DET/det/2 table/NOUN/dobj/0 below/ADP/prep/2 ./PUNCT/punct/0")
_SHOWN = ("It was shown above.", "it/PRON/nsubjpass/2 be/AUX/auxpass/2 show/VERB/ROOT/2 above/ADV/advmod/2 ./PUNCT/punct/2")
_SHELF = ("Clean the shelf above.", "clean/VERB/ROOT/0 the/DET/det/2 shelf/NOUN/dobj/0 above/ADV/advmod/2 ./PUNCT/punct/0")
_NOUN = lambda t: (t, "the/DET/det/1 x/NOUN/ROOT/1 ./PUNCT/punct/1")
_TRIAD = ("It is new, strange, and bold.", "it/PRON/nsubj/1 be/AUX/ROOT/1 new/ADJ/acomp/1 ,/PUNCT/punct/2 strange/ADJ/conj/2 ,/PUNCT/punct/4 and/CCONJ/cc/4 bold/ADJ/conj/4 ./PUNCT/punct/1")
_HOOK = _sentences(("The best part?", "the/DET/det/2 best/ADJ/amod/2 part/NOUN/ROOT/2 ?/PUNCT/punct/2"), ("It works.", "it/PRON/nsubj/1 work/VERB/ROOT/1 ./PUNCT/punct/1"))
_RANGE = ("It spans from strategy to execution.", "it/PRON/nsubj/1 span/VERB/ROOT/1 from/ADP/prep/1 strategy/NOUN/pobj/2 to/ADP/prep/2 execution/NOUN/pobj/4 ./PUNCT/punct/1")
_MOVED = ("It moved from strategy to execution.", "it/PRON/nsubj/1 move/VERB/ROOT/1 from/ADP/prep/1 strategy/NOUN/pobj/2 to/ADP/prep/2 execution/NOUN/pobj/4 ./PUNCT/punct/1")
_RUNS = ("It runs.", "it/PRON/nsubj/1 run/VERB/ROOT/1 ./PUNCT/punct/1")
_LATE = (" ".join(["Under"] + ["grey"] * 20 + ["skies", "ran", "he."]), " ".join(["under/ADP/prep/22"] + ["grey/ADJ/amod/21"] * 20 + ["sky/NOUN/pobj/0", "run/VERB/ROOT/22", "he/PRON/nsubj/22", "./PUNCT/punct/22"]))
_VAGUE = (" ".join(["Value"] + ["value"] * 11) + ".", " ".join(["value/NOUN/ROOT/0"] * 12 + ["./PUNCT/punct/0"]))
_STEP = ("- You should click the button.", "-/PUNCT/punct/3 you/PRON/nsubj/3 should/AUX/aux/3 click/VERB/ROOT/3 the/DET/det/5 button/NOUN/dobj/3 ./PUNCT/punct/3")
_COHERE = _sentences(("Red cats chase small mice daily.", "red/ADJ/amod/1 cat/NOUN/nsubj/2 chase/VERB/ROOT/2 small/ADJ/amod/4 mouse/NOUN/dobj/2 daily/ADV/advmod/2 ./PUNCT/punct/2"), ("Red cats chase big dogs often.", "red/ADJ/amod/1 cat/NOUN/nsubj/2 chase/VERB/ROOT/2 big/ADJ/amod/4 dog/NOUN/dobj/2 often/ADV/advmod/2 ./PUNCT/punct/2"), sep="\n\n")

#: Hand-made parses: (doc_id, kind, text, tokens).
PARSED: list[tuple[int, str, str, list[tuple]]] = [
    (i, kind, text, tokens_of(text, spec))
    for i, kind, (text, spec) in (
        (1, "text", _DECIDE),
        (2, "text", _THERE),
        (3, "text", _sentences(_TABLE, _SHOWN, _SHELF)),
        (4, "markdown", _STEP),
        (5, "text", _sentences(_NOUN("The jokes."), _NOUN("The wins."), _NOUN("The team."))),
        (6, "text", _sentences(_TRIAD, _TRIAD)),
        (7, "text", _HOOK),
        (8, "text", _sentences(_RANGE, _MOVED)),
        (9, "text", _sentences(*[_NOUN("The idea."), _RUNS] * 4)),
        (10, "text", _LATE),
        (11, "text", _VAGUE),
        (12, "text", _COHERE),
        (13, "text", ("", "")),
    )
]
RATINGS = {"strategy": 1.8, "execution": 2.5, "value": 1.9}

#: What those hold: (doc_id, code, severity, start, end, suggestion).
PARSED_FINDINGS: list[tuple] = [
    (1, "NB304", "info", 6, 21, "decide"),
    (2, "NB305", "info", 0, 9, None),
    (3, "NB310", "info", 4, 19, "the following table"),
    (3, "NB310", "info", 34, 39, "name or link the section: places move when text reflows"),
    (4, "NB314", "info", 2, 30, "Click the button"),
    (5, "NB507", "info", 0, 30, None),
    (6, "NB518", "info", 6, 28, None),
    (6, "NB518", "info", 36, 58, None),
    (7, "NB525", "info", 0, 24, None),
    (8, "NB526", "info", 9, 35, None),
    (9, "NB530", "info", 0, 9, None),
    (10, "NB203", "info", 0, 119, None),
    (11, "NB601", "info", 0, 72, None),
]

#: (doc_id, nominal_density, pronoun_density, paragraph_cohesion, dependency_distance, formality, modifier_density)
PARSED_STATISTICS: list[tuple] = [
    (1, 2 / 3, 0.0, 0.0, 4 / 3, 75.0, 0.5),
    (2, 0.5, 25.0, 0.0, 4 / 3, 50.0, 1.0),
    (12, 4 / 12, 0.0, 3 / 6, 8 / 5, (4 / 12 * 100 + 100) / 2, 1.0),
]
