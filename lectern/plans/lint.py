"""From documents to findings, statistics, hotspots and scores: narrow plans, without a shuffle.

``analyze`` reads each document once and leaves one row for it: its statistics and an array of findings. The other
functions project that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import text as T
from lectern.operators.parsed import TOKENS
from lectern.operators.postpass import analyze_rows, hotspot_rows
from lectern.operators.rules import NEEDS_VOCABULARY
from lectern.operators.stats import with_seconds


def analyze(df: DataFrame, config: Config | None = None, text: str = "text", kind: str = "text", name: str | None = None, id: str = "doc_id", all_stats: bool = False, tokens: str | None = None) -> DataFrame:
    """One row for each row of ``df``: id, ``name``, the statistics, ``counts``, ``findings`` and ``backend``.

    ``tokens`` names a column with the parse of each text (``parsed.TOKENS``); the rules and statistics that need one run then.
    Other columns of ``df`` are dropped, whatever their names; repeated rows repeat their result; ids may be null; an empty
    table gives an empty result.

    ``kind`` is text, markdown or html. A null text is an empty one.
    """
    c = config or Config()
    codes = c.reported()
    shown = F.col(name).cast("string") if name else F.col(id).cast("string")
    df = df.select(F.col(id), shown.alias("name"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_original"), *([F.col(tokens).cast(TOKENS).alias("_tokens")] if tokens else []))
    df = analyze_rows(df, c, kind, all_stats or bool(codes & NEEDS_VOCABULARY))
    return with_seconds((df if kind != "text" else df.withColumn("_analysis", F.col("_original"))).withColumn("backend", F.lit(c.backend)))


def _rows(df: DataFrame, array: str) -> DataFrame:
    """A row for each struct of an array, and one of nulls for none.

    The outer form on purpose: for the inner one the optimizer infers a filter on the array and pushes it down through
    every projection that made it, which copies the plan over and over; and it extracts fields below an explode.
    """
    return df.select(*(F.col(c) for c in df.columns if c != array), F.inline_outer(array))


def findings(analyzed: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row a finding."""
    return _rows(analyzed.withColumnRenamed("name", "path").select(id, "path", "backend", "findings"), "findings").where("code is not null")


def stats(analyzed: DataFrame) -> DataFrame:
    return analyzed.drop("findings", "_original", "_analysis")


def statistics(analyzed: DataFrame) -> DataFrame:
    """Findings by code: counted in each partition first."""
    return _rows(analyzed.select("findings"), "findings").where("code is not null").groupBy("code", "name").agg(F.count("*").alias("n"))


def hotspots(analyzed: DataFrame, limit: int = 3, id: str = "doc_id") -> DataFrame:
    """The paragraphs of each document with the most weight of findings a hundred words, worst first."""
    return hotspot_rows(analyzed.select(id, "name", "_original", "_analysis", "findings"), limit)


DOCUMENT_LEVEL = ("NB506", "NB508", "NB509", "NB527", "NB528", "NB529", "NB530")
TOOL_MARKS = ("NB513", "NB519")


def score(analyzed: DataFrame, id: str = "doc_id") -> DataFrame:
    """Likeness to machine writing, 0 to 100, and its parts; null for texts too short. Needs the NB5 rules and all statistics."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    half_even = lambda x: F.bround(x).cast("int")
    two = lambda c: T.rounded(F.col(c), 2)
    five = F.filter("findings", lambda f: f["code"].startswith("NB5"))
    tells = F.size(F.filter(five, lambda f: ~f["code"].isin(*DOCUMENT_LEVEL, *TOOL_MARKS)))
    marks = F.size(F.filter(five, lambda f: f["code"].isin(*TOOL_MARKS)))
    df = analyzed.withColumn("tells", tells).withColumn("artifacts", marks)
    parts = {
        "burstiness_risk": unit((F.lit(0.6) - two("burstiness")) / F.lit(0.6 - 0.2)) * 25,
        "seg_risk": unit((F.lit(0.75) - two("seg_burstiness")) / F.lit(0.75 - 0.45)) * 10,
        "tell_risk": unit(F.col("tells") / F.col("n_words") * 100 / F.lit(4.0)) * 40,
        "artifact_risk": F.least(F.col("artifacts") * 6, F.lit(15)).cast("double"),
        "diversity_risk": unit((F.lit(0.55) - two("mattr")) / F.lit(0.55 - 0.45)) * 10,
    }
    total = sum(parts.values(), F.lit(0.0))
    long = (F.col("n_words") >= 25) & (F.col("n_sentences") >= 3)
    s = F.when(long, half_even(F.least(F.lit(100.0), total)))
    band = F.when(s < 25, "reads human").when(s < 50, "leans human").when(s < 75, "leans AI").when(s.isNotNull(), "reads AI")
    return df.select(id, "name", s.alias("score"), band.alias("band"), "tells", "artifacts", *(F.when(long, half_even(v)).alias(k) for k, v in parts.items()))


# -- reports


def _fix() -> Column:
    s = F.col("suggestion")
    return F.when(s.isNull(), "").when(F.col("applicability") == "replace", F.when(s == "", " → delete it").otherwise(F.concat(F.lit(" → "), s))).otherwise(F.concat(F.lit(" try: "), s))


def report_lines(found: DataFrame) -> DataFrame:
    """One ``path:line:col: CODE message fix`` a finding."""
    line = F.concat(F.format_string("%s:%d:%d: %s ", "path", "line", "col", "code"), T.flat(F.col("message")), _fix())
    return found.select("path", "line", "col", line.alias("value"))


def workflow_lines(found: DataFrame) -> DataFrame:
    """Annotations of a workflow log: ``::level file=,line=,col=::body``."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    body = F.concat(F.col("code"), F.lit(" "), F.col("message"), F.when(_fix() == "", "").otherwise(F.concat(F.lit("\n"), F.ltrim(_fix()))))
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return found.select("path", "line", "col", F.concat(F.lit("::"), level, F.format_string(" file=%s,line=%d,col=%d::", "path", "line", "col"), body).alias("value"))


def json_reports(analyzed: DataFrame) -> DataFrame:
    """One JSON object a document: path, summary, diagnostics. Statistics are rounded here and nowhere else."""
    keep = ("grade", "readability", "n_words", "n_sentences", "burstiness", "seg_burstiness", "mattr", "temporal_ratio", "reading_time_secs", "counts")
    short = {"n_words": "words", "n_sentences": "sentences"}
    digits = {"burstiness": 2, "seg_burstiness": 2, "mattr": 2, "temporal_ratio": 2, "reading_time_secs": 1}
    summary = F.struct(*((T.rounded(F.col(k), digits[k]) if k in digits else F.col(k)).alias(short.get(k, k)) for k in keep if k in analyzed.columns))
    fields = ("code", "name", "message", "severity", "line", "col", "end_line", "end_col", "suggestion", "applicability", "text")
    found = F.transform("findings", lambda f: F.struct(*(f[k].alias(k) for k in fields)))
    return analyzed.select("name", F.to_json(F.struct(F.col("name").alias("path"), summary.alias("summary"), found.alias("diagnostics")), {"ignoreNullFields": "false"}).alias("value"))


def documents_stats_lines(analyzed: DataFrame) -> DataFrame:
    average = F.when(F.col("n_sentences") > 0, F.col("n_words") / F.col("n_sentences")).otherwise(0.0)
    return analyzed.select("name", F.format_string("%s: grade=%d level=%s words=%d sentences=%d avg_sentence=%.1f burstiness=%.2f diversity=%.2f temporal_connectives=%.2f read_secs=%.0f", "name", "grade", "readability", "n_words", "n_sentences", average, "burstiness", "mattr", "temporal_ratio", "reading_time_secs").alias("value"))
