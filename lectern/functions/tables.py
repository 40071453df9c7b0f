"""Word lists and thresholds. The lists are one table, (list, phrase, fix, alternatives), shipped with the package."""

from __future__ import annotations

import csv
from functools import lru_cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def rows() -> list[dict]:
    text = resources.files("lectern").joinpath("data", "lexicon.tsv").read_text(encoding="utf-8")
    return [r | {"alternatives": r["alternatives"].split("|") if r["alternatives"] else []} for r in csv.DictReader(text.splitlines(), delimiter="\t", quoting=csv.QUOTE_NONE)]


@lru_cache(None)
def phrases(name: str) -> dict[str, dict]:
    """One list: phrase to its row."""
    return {r["phrase"]: r for r in rows() if r["list"] == name}


def lexicon(spark: SparkSession) -> DataFrame:
    """All lists as a table."""
    return spark.createDataFrame([(r["list"], r["phrase"], r["fix"], r["alternatives"]) for r in rows()], "list string, phrase string, fix string, alternatives array<string>")


#: target: (words below which nothing is hard, grade from which on hard, very hard)
TARGETS = {"ACCESSIBLE": (8, 8, 12), "NORMAL": (14, 10, 14), "TECHNICAL": (14, 14, 18), "ESSAY": (14, 14, 18), "SOCIAL": (8, 8, 12), "EMAIL": (8, 10, 14)}
#: target: (variation of sentence lengths below which the rhythm is flat, and so flat as to warn)
RHYTHM = {"ACCESSIBLE": (0.32, 0.20), "NORMAL": (0.40, 0.28), "TECHNICAL": (0.40, 0.28), "ESSAY": (0.40, 0.28), "SOCIAL": (0.30, 0.20), "EMAIL": (0.38, 0.25)}
OFF = {"SOCIAL": ("NB203", "NB507", "NB512", "NB529", "NB530", "NB308", "NB309", "NB310", "NB314"), "ESSAY": ("NB308", "NB314", "NB316")}
BUDGET_CODES = ("NB301", "NB302", "NB303", "NB304", "NB305", "NB401")
#: target: findings a 1000 words that stay advisory, by BUDGET_CODES
BUDGETS = {"ACCESSIBLE": (10, 5, 8, 2, 2, 2), "NORMAL": (15, 8, 10, 2, 5, 3), "TECHNICAL": (10, 15, 8, 3, 4, 3), "ESSAY": (25, 15, 15, 3, 6, 6), "SOCIAL": (15, 5, 10, 2, 4, 3), "EMAIL": (10, 5, 8, 2, 3, 2)}
#: a finding of the first code gives way to an overlapping one of these
PRECEDENCE = {"NB301": ("NB303", "NB308", "NB316", "NB510", "NB520"), "NB302": ("NB316",), "NB510": ("NB308",)}
TEMPORAL, ADDITIVE = tuple(phrases("temporal")), tuple(phrases("additive"))
#: in the order in which they are tried
CONNECTORS = tuple(sorted(phrases("connector"), key=lambda c: int(phrases("connector")[c]["fix"])))
#: a list of our own
FUNCTION_WORDS = tuple(
    sorted(
        "i me my you your he him his she her it its we us our they them their who whom whose which what this that these those there here one some any no none not all both each few more most other such only own same so than too very just now then "
        "am is are was were be been being have has had do does did can could may might must shall should will would "
        "and but or nor if because as until while although though since unless whether when where why how "
        "a an the of to in for on with at by from into onto over under about against between through during before after above below up down out off again once per via".split()
    )
)
MARKS = {"em_dash": "—", "en_dash": "–", "semicolon": ";", "colon": ":", "paren_open": "(", "question": "?", "exclamation": "!", "ellipsis": "…"}
PUNCTUATION = MARKS | {"comma": ","}
