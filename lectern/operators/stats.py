"""One row of statistics for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.reading import MEASURES, VOCABULARY, told


def _with(df: DataFrame, text: str, names: tuple[str, ...], target: str = "NORMAL") -> DataFrame:
    df = df.withColumn("_told", told(F.col(text), names, target))
    return df.select(*(c for c in df.columns if c != "_told" and c not in names), *(F.col(f"_told.{n}").alias(n) for n in names))


def measure(df: DataFrame, text: str = "text", target: str = "NORMAL") -> DataFrame:
    """``df`` with ``sentences`` (array), counts, ``grade``, ``readability`` and the rhythm measures. No shuffle."""
    return _with(df, text, ("sentences", *MEASURES), target)


def with_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``mattr``, ``n_alpha`` and ``temporal_ratio``."""
    return _with(df, text, VOCABULARY)


def document_stats(df: DataFrame, text: str = "text", target: str = "NORMAL") -> DataFrame:
    """The statistics that need no tagger, in full precision, beside the other columns of ``df``; the text is dropped."""
    return with_seconds(_with(df, text, (*MEASURES, *VOCABULARY), target)).drop(text)


def with_seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("reading_time_secs", F.col("n_words") / F.lit(250.0) * F.lit(60.0))
