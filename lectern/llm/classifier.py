"""Quality classifier: hierarchical empirical Bayes over a document classifier, hosts and paths.

A logistic model on the transformed statistics of a text (``rules``), trained on a bounded sample of labelled rows,
gives each document its evidence. Hosts, and paths within hosts, have posterior means: the expected share of good
documents is drawn towards the host's (for a path) or the global (for a host) share as strongly as if a prior number of
documents had shown that share, where these numbers are estimated from the spread between sites by moments (few
documents, or sites alike, shrink more). The score adds to a document's log odds those of its path, without the
document itself, over the global ones. Sites only meet in grouped sums of whole numbers.

Toxic texts can be well formed, so they have an evidence of their own: a second model, on words (``wording``), trained
on the labels of toxicity, whose log odds of a clean text go through the same shrinkage. A text stays if it is both
good and clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.rules import SCALE, STATS, measure
from lectern.llm.store import table
from lectern.llm.textbytes import as_bytes, chunks
from lectern.llm.wording import Wording, learn

#: Labelled rows to train on, at most about; chosen by a hash of their id.
SAMPLE_ROWS = 20_000
#: Shares are summed as whole numbers of this part, so sums don't depend on the order of tasks.
UNIT = 1_000_000
#: How much of a path's log odds counts.
WEIGHT = 0.5
EXTRA = ("x_words", "x_lines")
FEATURES = (*STATS, *EXTRA)


def statistics(df: DataFrame, id: str, text: str, host: str, path: str, toxic: Wording) -> DataFrame:
    """``_id, host, path``, the features in whole numbers, and ``toxic``, the log odds by wording."""
    kind = df.schema[id].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(toxic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, o in chunks(batch.column(3)):
                m = measure(b, o)
                m["x_words"] = np.round(np.log1p(m["n_words"]) * SCALE / 4)
                m["x_lines"] = np.round(np.log1p(m["n_dup_lines"]) * SCALE / 2)
                words = sent.value.evidence(*as_bytes(pc.utf8_lower(batch.column(3).slice(i, j - i))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), *(pa.array(np.asarray(m[c]).astype(np.int32)) for c in FEATURES), pa.array(words)], names=["_id", "host", "path", *FEATURES, "toxic"])

    return df.select(F.col(f"`{id}`"), F.col(f"`{host}`").cast("string"), F.col(f"`{path}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(run, f"_id {kind}, host string, path string, {', '.join(f'{c} int' for c in FEATURES)}, toxic double")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model, the last one its constant, by Newton's steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[-1, -1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


def _strength(sums: DataFrame, mean: Column) -> DataFrame:
    """One row: how many documents the prior counts for, by moments of the shares of sites about ``mean``."""
    share = F.col("s") / F.lit(float(UNIT)) / F.col("n")
    m = F.sum(F.col("n") * mean) / F.sum("n")
    between = F.sum(F.col("n") * F.pow(share - mean, 2)) / F.sum("n")
    within = F.sum(share * (1 - share)) / F.sum("n")  # what chance alone would give
    extra = F.greatest(between - within, F.lit(1e-6))
    return sums.agg(F.least(F.greatest(m * (1 - m) / extra - 1, F.lit(2.0)), F.lit(1e4)).alias("strength"))


def _shrink(out: DataFrame, scored: DataFrame, kind: str) -> DataFrame:
    """``out``, whose rows are those of ``scored``, with posteriors and score by its ``{kind}evidence``."""
    of = lambda column: F.round(F.lit(float(UNIT)) / (1 + F.exp(-F.col(column)))).cast("bigint")
    paths = table(scored.groupBy("host", "path").agg(F.sum(of(f"{kind}evidence")).alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = (whole["s"] or 0) / UNIT / max(whole["n"] or 0, 1)
    strong = _strength(hosts, F.lit(mean)).first()["strength"] or 2.0
    hosts = table(hosts.withColumn("host_posterior", (F.col("s") / F.lit(float(UNIT)) + F.lit(strong * mean)) / (F.col("n") + F.lit(strong))).select(F.col("host").alias("h2"), "host_posterior"), "hosts")
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h2"))).drop("h2")
    strong_path = _strength(paths, F.col("host_posterior")).first()["strength"] or 2.0
    sites = paths.select(F.col("host").alias("h2"), F.col("path").alias("p2"), "s", "n", F.col("host_posterior").alias(f"{kind}host_posterior"))
    out = out.join(sites, F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")))
    prior = F.lit(strong_path) * F.col(f"{kind}host_posterior")
    posterior = (F.col("s") / F.lit(float(UNIT)) + prior) / (F.col("n") + F.lit(strong_path))
    others = ((F.col("s") - of(f"{kind}evidence")) / F.lit(float(UNIT)) + prior) / (F.col("n") - 1 + F.lit(strong_path))
    score = 1 / (1 + F.exp(-(F.col(f"{kind}evidence") + F.lit(WEIGHT) * (_logit(others) - _logit(F.lit(float(mean)))))))
    return out.withColumn(f"{kind}path_posterior", posterior).withColumn(f"{kind}score", score).drop("h2", "p2", "s", "n")


def _bounded(e: Column) -> Column:
    return F.greatest(F.least(e, F.lit(30.0)), F.lit(-30.0))


def classify(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", sample_rows: int = SAMPLE_ROWS, cut: float = 0.5, toxic: str = "toxic") -> DataFrame:
    """One row for each row of ``df``: id, ``evidence`` (log odds by the text), ``host_posterior``, ``path_posterior``, ``score``, ``kept``; and of its being clean ``clean_evidence``, ``clean_host_posterior``, ``clean_path_posterior``, ``clean_score``.

    ``kept`` if both scores reach ``cut``. ``labels`` has the id and 0 or 1 in ``label`` and ``toxic``; null labels are
    left out, an id with several labels counts once for each. Null and empty texts are scored like any other; null hosts
    and paths are sites of their own. Without quality labels of both kinds the evidence is 0 and every score is a half, so
    that no row goes by it; without toxicity labels of both kinds, or the column, the same holds for being clean (its
    posteriors are null). Repeated rows each count and get equal results; an empty table gives an empty result.
    """
    share = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def chosen(label: str) -> DataFrame:
        marks = labels.select(F.col(f"`{id}`").alias("_key"), F.col(f"`{label}`").cast("double").alias("y")).where("_key is not null and y is not null")
        return marks.where(share < min(1.0, sample_rows / max(marks.count(), 1)))

    wording = Wording.none()
    if toxic in labels.columns:
        wording = learn(df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen(toxic)), F.col("_id") == F.col("_key")).select("text", "y"))
    rows = table(statistics(df, id, text, host, path, wording), "statistics")
    train = rows.join(chosen(label), F.col("_id") == F.col("_key")).select("_id", *FEATURES, "y").orderBy("_id", "y", *FEATURES).toPandas()
    x, y = train[list(FEATURES)].to_numpy(float) / SCALE, train["y"].to_numpy(float)
    w = fit(x, y) if 0 < y.sum() < len(y) else np.zeros(len(FEATURES) + 1)
    evidence = F.lit(float(w[-1]))
    for k, f in enumerate(FEATURES):
        evidence = evidence + F.col(f) / F.lit(float(SCALE)) * F.lit(float(w[k]))
    scored = rows.select("_id", "host", "path", _bounded(evidence).alias("evidence"), _bounded(-F.col("toxic")).alias("clean_evidence"))
    out = _shrink(scored, scored, "")
    if wording.learned:
        out = _shrink(out, scored, "clean_")
    else:
        out = out.withColumns({"clean_host_posterior": F.lit(None).cast("double"), "clean_path_posterior": F.lit(None).cast("double"), "clean_score": F.lit(0.5)})
    kept = (F.col("score") >= cut) & ((F.col("clean_score") >= cut) | F.lit(not wording.learned))
    return out.select(F.col("_id").alias(id), "evidence", "host_posterior", "path_posterior", "score", kept.alias("kept"), "clean_evidence", "clean_host_posterior", "clean_path_posterior", "clean_score")
