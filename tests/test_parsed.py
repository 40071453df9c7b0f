"""Rules over a hand-made parse, and the kernel of the post-passes, without Spark."""

from __future__ import annotations

import random

from lectern.config import Config
from lectern.fixtures import PARSED, PARSED_FINDINGS, PARSED_STATISTICS, RATINGS
from lectern.functions.lexicon import find, flattest_run, resolve
from lectern.operators.parsed import RULES, STATISTICS, Parse, parsed, trigrams
from lectern.operators.postpass import Lines, Spans, settle

FIELDS = ("start", "end", "lemma", "pos", "dep", "head", "sent", "stop")


def run(kind: str, text: str, tokens: list[tuple], ratings=RATINGS):
    return parsed(text, [dict(zip(FIELDS, t)) for t in tokens], set(RULES), text, kind, ratings)


def test_rules_over_a_parse():
    got = [(i, f["code"], f["start"], f["end"], f["suggestion"]) for i, kind, text, tokens in PARSED for f in run(kind, text, tokens)[0]]
    want = [(i, code, start, end, fix) for i, code, _, start, end, fix in PARSED_FINDINGS]
    assert set(want) <= set(got)
    # the other rules stay silent, but for the fragments of 5, 7 and 9, which rules of their own see
    assert {x[:2] for x in set(got) - set(want)} == set()


def test_statistics_over_a_parse():
    want = {i: dict(zip(STATISTICS, values)) for i, *values in PARSED_STATISTICS}
    for i, kind, text, tokens in PARSED:
        got = run(kind, text, tokens)[1]
        for name, value in want.get(i, {}).items():
            assert abs(got[name] - value) < 1e-12, (i, name)
    assert set(run("text", "", [])[1].values()) == {0.0}


def test_a_parse_may_be_poor():
    """Heads out of range, nulls and no ratings."""
    tokens = [{"start": 0, "end": 4, "lemma": None, "pos": None, "dep": None, "head": 99, "sent": None, "stop": None}]
    assert parsed("Here", tokens, set(RULES), "Here", "text", None)[0] == []
    p = Parse("a b c d", [dict(zip(FIELDS, (2 * i, 2 * i + 1, "x", pos, "", i, i == 0, False))) for i, pos in enumerate(("DET", "ADJ", "NOUN", "NOUN"))])
    assert trigrams(p) == {"DET ADJ NOUN": 1, "ADJ NOUN NOUN": 1}


def test_spans():
    x = random.Random(3)
    for _ in range(400):
        spans = [(a := x.randint(0, 40), a + x.randint(1, 9)) for _ in range(x.randint(0, 8))]
        s, start = Spans(spans), x.randint(0, 40)
        end = start + x.randint(1, 9)
        assert s.contains(start, end) == any(a <= start and end <= b for a, b in spans)
        assert s.meets(start, end) == any(a < end and start < b for a, b in spans)
        assert s.overlap(start, end) == sum(max(0, min(end, b) - max(start, a)) for a, b in spans)


def test_settle():
    f = lambda code, a, b: {"code": code, "name": "", "message": "", "severity": "warning", "suggestion": None, "applicability": "advisory", "text": "", "start": a, "end": b}
    text = "one two\n> quoted words here\nthree lectern: ignore NB401\nfour"
    found = [f("NB401", 0, 3), f("NB303", 10, 16), f("NB401", 28, 33), f("NB306", 28, 33), f("NB301", 56, 60), f("NB303", 56, 60)]
    kept, counts = settle(found, text, text, 9, "normal", 12, Config(max_grade=9), "markdown")
    assert [(k["code"], k["line"], k["col"], k["severity"]) for k in kept] == [("NB101", 1, 1, "error"), ("NB401", 1, 1, "info"), ("NB306", 3, 1, "warning"), ("NB303", 4, 1, "info")]
    assert counts["complexWords"] == 1 and counts["adverbs"] == 0
    assert Lines("a\nbc")(3) == (2, 2) and settle([], "", "", 0, "normal", 0, Config(), "text")[0] == []


def test_flattest_run_is_linear():
    assert flattest_run([7] * 100_000) == (0, 100_000) and flattest_run(([7] * 50_000 + [90]) * 2) == (0, 50_000)


def test_characters_round_a_phrase():
    """However much white space there is."""
    for gap in (1, 63, 64, 65, 500):
        hit = find("," + " " * gap + "in order to" + " " * gap + ";", ("complex",), False)[0]
        assert hit[-2:] == (",", ";")


def test_resolve():
    x = random.Random(2)
    for _ in range(500):
        matches = [(x.randint(1, 4), s := x.randint(0, 40), s + x.randint(1, 8), "p") for _ in range(x.randint(0, 12))]
        kept: list = []
        for m in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(m[2] <= a or m[1] >= b for _, a, b, _ in kept):
                kept.append(m)
        assert resolve(matches) == sorted(kept, key=lambda m: m[1])
