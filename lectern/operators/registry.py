"""The catalogue of rules: code, name, what it needs, and whether it runs by default.

``needs`` says what a rule reads beyond characters and tokens: nothing, ``norms`` (a table of concreteness ratings,
supplied by the user), ``profile`` (an author's profile), ``tagger`` (lemmas and parts of speech) or ``parser``. What runs
is in ``mode``: ``parse`` (exactly, over the user's column of tokens, and not without one), ``phrases`` (their fixed phrases),
``classic`` (a surface rule of its own, not the parser's answer), ``forms`` (listed words and, with the lexical
backend, their regular inflections instead of lemmas).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    code: str
    name: str
    needs: str = ""
    default: bool = True
    mode: str = "exact"


def _entries() -> list[Entry]:
    e = Entry
    return [
        e("NB101", "readability"), e("NB201", "very-hard-sentence"), e("NB202", "hard-sentence"), e("NB203", "periodic-sentence", "parser", mode="parse"),
        e("NB301", "adverb", "tagger", mode="classic"), e("NB302", "passive-voice", "parser", mode="classic"), e("NB303", "qualifier"), e("NB304", "nominalization", "parser", mode="parse"), e("NB305", "dummy-subject", "parser", mode="parse"), e("NB306", "repeated-word"),
        e("NB307", "uncomparable", "tagger", mode="forms"), e("NB308", "condescending", "parser", mode="phrases"), e("NB309", "undefined-acronym", "norms"), e("NB310", "directional-language", "parser", mode="parse"), e("NB311", "image-no-alt"), e("NB312", "vague-link-text"), e("NB313", "heading-punctuation"),
        e("NB314", "non-imperative-step", "parser", mode="parse"), e("NB315", "exclusionary-term", default=False), e("NB316", "nameless-authority", "parser", mode="phrases"), e("NB317", "hidden-character"), e("NB401", "complex-phrase"),
        e("NB501", "ai-negation-contrast", default=False), e("NB502", "ai-puffery", "tagger", False, "forms"), e("NB503", "ai-editorializing", "tagger", False, "forms"), e("NB504", "ai-filler", "tagger", False, "forms"), e("NB505", "ai-transition", "tagger", False, "forms"), e("NB506", "ai-em-dash", default=False),
        e("NB507", "ai-rule-of-three", "tagger", False, "parse"), e("NB508", "ai-emoji", default=False), e("NB509", "ai-monotonous-rhythm", default=False), e("NB510", "ai-intensifier", "", False, "forms"), e("NB511", "ai-participial-closer", default=False), e("NB512", "ai-repeated-opener", default=False), e("NB513", "ai-curly-quote", default=False),
        e("NB514", "ai-title-case-heading", default=False), e("NB515", "ai-predicate-hyphen", default=False), e("NB516", "ai-bold-listicle", default=False), e("NB517", "ai-vocab-cluster", "tagger", False, "forms"), e("NB518", "ai-adjective-triad", "tagger", False, "parse"), e("NB519", "ai-artifact", default=False), e("NB520", "ai-hedge-stack", default=False),
        e("NB521", "ai-paragraph-opener", default=False), e("NB522", "ai-engagement-bait", default=False), e("NB523", "ai-anaphora-triad", default=False), e("NB524", "ai-contrast-heading", default=False), e("NB525", "ai-hook-question", "tagger", False, "parse"), e("NB526", "ai-false-range", "parser", False, "parse"), e("NB527", "ai-uniform-paragraphs", default=False),
        e("NB528", "ai-low-lexical-diversity", default=False), e("NB529", "ai-punchline-endings", default=False), e("NB530", "ai-fragment-density", "parser", False, "parse"), e("NB531", "ai-bolted-connector", default=False), e("NB532", "ai-asserted-unity", default=False),
        e("NB601", "low-concreteness", "norms", mode="parse"), e("NB701", "style-connector", "profile"), e("NB702", "style-rhythm", "profile"), e("NB703", "style-punctuation", "profile"), e("NB704", "style-authorship", "profile"), e("NB801", "readme-no-description"),
    ]


ENTRIES = {e.code: e for e in _entries()}


def rules(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    return spark.createDataFrame([(e.code, e.name, e.needs, e.default, e.mode) for e in ENTRIES.values()], "code string, name string, needs string, default_on boolean, mode string")
