"""Quality rules: base counts of each text, then robust multivariate outliers by language and source.

Each text gives a vector of transformed statistics. For each group (language, source), each language and the whole, the
location and scatter are minimum-covariance-determinant estimates: concentration steps take the ``SUPPORT`` share of
documents at the least Mahalanobis distance and estimate anew from those, from several starts that all documents have a part
in; the start of the least determinant goes on until it settles. Every step is a grouped aggregation over all documents:
counts of distances in bins, of those within the bin that bounds the support in steps of it, and sums of coordinates and of
their products, in whole numbers, so that results do not depend on the order of tasks. Nothing but these reaches a shuffle.
Estimates of groups are drawn towards those of their language, more so the fewer documents they have. A text is rejected
when its squared distance is beyond a chi-square quantile that is corrected for the documents the estimate comes from.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.store import table
from lectern.llm.textbytes import Words, chunks, distinct_spans, grams, mix, per_row, release

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
SHOUT = np.zeros(256, bool)
SHOUT[list(b"!?")] = True

STATS = ("x_symbol", "x_upper", "x_shout", "x_length", "x_duplicate", "x_repeat", "x_run")
SCALE = 256
#: Words a repeated phrase may have to count as a run; longer ones are seen by windows of eight words.
PERIOD = 8
SUPPORT = 0.75
#: Logarithm of the chance that a text of a Gaussian group lies beyond the cutoff.
LOG_TAIL = -27 * math.log(10)
#: Least scatter of a coordinate, in units of the coordinate: a statistic that is constant in the support still varies.
FLOOR = 0.04
#: Documents of the parent that a group's estimate is drawn towards.
PRIOR = 60
#: A step that lessens the logarithm of the determinant by less ends the concentration.
SETTLED = 1e-3
#: Shares are summed as whole numbers of this part.
UNIT = 1 << 16


def _count(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _again(word: np.ndarray, at: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of ``k`` words that start at ``at`` occur more than once in their text. Hashes find them, words decide."""
    g = grams(mix(word.astype(np.uint64)), k)[at]
    order = np.lexsort((g, doc))
    twin = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    x, y = at[order[1:][twin]], at[order[:-1][twin]]
    again = np.zeros(len(at), bool)
    if all((word[x + i] == word[y + i]).all() for i in range(k)):
        again[order[1:][twin]] = again[order[:-1][twin]] = True
    else:  # a collision: compare all words
        runs = np.column_stack([doc, *(word[at + i] for i in range(k))])
        _, where, n = np.unique(runs, axis=0, return_inverse=True, return_counts=True)
        again = n[where.ravel()] > 1
    return again


def measure(b: np.ndarray, o: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text of a run of texts."""
    n = len(o) - 1
    w = Words(b, o)
    counts = w.counts()
    lead = (b & 0xC0) != 0x80
    points = np.zeros(len(b) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    out = {"n_words": counts, "word_chars": per_row(points[w.end] - points[w.start], w.first), "n_symbols": _count(SYMBOL[b], o)}
    # lines: between newlines and the ends of texts; those with a word count, equal ones after the first
    newline = np.flatnonzero(b == 10)
    doc_of = lambda at: np.searchsorted(o, at, "right") - 1
    nonempty = np.flatnonzero(o[1:] > o[:-1])
    start = np.sort(np.concatenate([o[nonempty], newline + 1]))
    end = np.sort(np.concatenate([newline, o[nonempty + 1]]))
    doc = np.sort(np.concatenate([nonempty, doc_of(newline)]))
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[has], end[has], doc[has]
    line, _ = distinct_spans(b, start, end)
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(np.unique(doc * (len(doc) + 1) + line) // (len(doc) + 1), minlength=n)
    # words in windows of eight that occur twice in their text
    k = 8
    word, _ = w.codes()
    ok = w.gram_starts(k)
    covered = np.zeros(len(w.start) + 1, np.int64)
    if ok.any():
        at = np.flatnonzero(ok)
        starts = at[_again(word, at, w.doc()[at], k)]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + k, -1)
    out["n_repeat_words"] = per_row(np.cumsum(covered)[:-1] > 0, w.first)
    # words that go on a run of one word or of a period of two to PERIOD words, at least two in step
    run = np.zeros(len(word), bool)
    place = np.arange(len(word)) - np.repeat(w.first[:-1], counts)
    for back in range(1, PERIOD + 1):
        step = np.zeros(len(word), bool)
        step[back:] = (word[back:] == word[:-back]) & (place[back:] >= back)
        if back > 1:
            both = step[1:] & step[:-1] & (place[1:] > 0)
            step[:] = False
            step[1:] |= both
            step[:-1] |= both
        run |= step
    lines = np.bincount(doc, minlength=n)
    chars = np.diff(points[o])
    fold = {"symbol": out["n_symbols"], "upper": _count(UPPER[b], o), "shout": _count(SHOUT[b], o)}
    # shares as arcsines of their roots, drawn towards a usual share by a few invented characters: short texts stay near
    x = {f"x_{k}": np.arcsin(np.sqrt((v + 2.0) / (chars + 100.0))) * 4 for k, v in fold.items()}
    x["x_length"] = np.log((out["word_chars"] + 120.0) / (counts + 20.0)) * 2
    x["x_duplicate"] = np.arcsin(np.sqrt((out["n_dup_lines"] + 0.5) / (lines + 8.0))) * 2
    x["x_repeat"] = np.arcsin(np.sqrt(np.minimum(1.0, (out["n_repeat_words"] + 2.0) / (counts + 60.0)))) * 2
    x["x_run"] = np.arcsin(np.sqrt((per_row(run, w.first) + 2.0) / (counts + 60.0))) * 2
    return out | {k: np.round(v * SCALE).astype(np.int64) for k, v in x.items()}


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_statistics(df: DataFrame, id: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``_id, lang, source``, the base counts, ``base_failed`` and the transformed statistics, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, o in chunks(batch.column(3)):
                m = measure(b, o)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), *(pa.array(m[c], pa.int64()) for c in BASE), pa.array(failed), *(pa.array(m[c], pa.int32()) for c in STATS)], names=["_id", "lang", "source", *BASE, "base_failed", *STATS])
        release()

    kind = df.schema[id].dataType.simpleString()
    schema = f"_id {kind}, lang string, source string, {', '.join(f'{c} bigint' for c in BASE)}, base_failed boolean, {', '.join(f'{c} int' for c in STATS)}"
    return df.select(F.col(f"`{id}`"), *(F.col(f"`{c}`").cast("string") for c in groups), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Starts of the concentration: medians with their spreads; with correlations of squashed coordinates; with those of directions.
STARTS = 3
#: Distances are told apart in their logarithm, in bins and then in steps of a bin.
BINS, STEPS = 8, 4096
ESTIMATE = "grp string, start int, n bigint, logdet double, done boolean, " + ", ".join(f"c{i} double" for i in range(P)) + ", " + ", ".join(f"v{i}_{j} double" for i, j in PAIRS)


def chi2_tail(x: float, p: float) -> float:
    """Logarithm of the chance that a sum of ``p`` squared Gaussians exceeds ``x``: the upper incomplete gamma function."""
    a, z = p / 2, x / 2
    if z < a + 1:  # series of the lower one
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= z / n
            total += term
        return math.log1p(-min(1 - 1e-16, total * math.exp(a * math.log(z) - z - math.lgamma(a)))) if z > 0 else 0.0
    b, c = z + 1 - a, 1e300  # continued fraction
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return a * math.log(z) - z - math.lgamma(a) + math.log(h)


def chi2_quantile(log_tail: float, p: float) -> float:
    """The squared distance beyond which a Gaussian of ``p`` coordinates lies with this (logarithm of a) chance."""
    low, high = 0.0, 10.0
    while chi2_tail(high, p) > log_tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, p) > log_tail else (low, mid)
    return high


#: Scatter of the SUPPORT share at the least distances understates that of all by this, for a Gaussian.
CONSISTENCY = SUPPORT / -math.expm1(chi2_tail(chi2_quantile(math.log(1 - SUPPORT), P), P + 2))


def _numbers(t: pd.DataFrame, name: str) -> np.ndarray:
    return t[[f"{name}{i}" for i in range(P)]].to_numpy(float)


def _square(t: pd.DataFrame, name: str) -> np.ndarray:
    out = np.zeros((len(t), P, P))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = t[f"{name}{i}_{j}"].to_numpy(float)
    return out


def _estimate(t: pd.DataFrame, start, n, centre: np.ndarray, scatter: np.ndarray, done=False) -> pd.DataFrame:
    """Rows of ESTIMATE, with FLOOR added to each scatter."""
    scatter = scatter + np.eye(P) * FLOOR**2
    logdet = np.linalg.slogdet(scatter)[1] if len(t) else np.zeros(0)
    columns = {"grp": t["grp"].tolist(), "start": start, "n": n, "logdet": logdet, "done": done}
    return pd.DataFrame(columns | {f"c{i}": centre[:, i] for i in range(P)} | {f"v{i}_{j}": scatter[:, i, j] for i, j in PAIRS})


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        n = t["n"].to_numpy()
        centre, spread = _numbers(t, "m") / SCALE, 1.4826 * _numbers(t, "s") / SCALE
        both = spread[:, :, None] * spread[:, None, :]
        squashed, mean = _square(t, "t") / UNIT / n[:, None, None], _numbers(t, "t") / UNIT / n[:, None]
        squashed = squashed - mean[:, :, None] * mean[:, None, :]
        own = np.sqrt(np.maximum(np.einsum("nii->ni", squashed), 1e-12))
        for k, scatter in enumerate((both * np.eye(P), both * squashed / (own[:, :, None] * own[:, None, :]), both * _square(t, "u") / UNIT / n[:, None, None] * P)):
            yield _estimate(t, k, n, centre, scatter)


def _concentrated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The estimate of each group's support, and whether its determinant is no longer the less for it."""
    for t in batches:
        h = t["h"].to_numpy(float)[:, None]
        centre = _numbers(t, "s") / h
        scatter = _square(t, "p") / h[:, :, None] - centre[:, :, None] * centre[:, None, :]
        out = _estimate(t, t["start"].tolist(), t["n"].tolist(), centre / SCALE, scatter / SCALE**2)
        out["done"] = out["logdet"].to_numpy() > t["was"].to_numpy() - SETTLED
        yield out


def _inverses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        inverse = np.linalg.inv(_square(t, "v")) if len(t) else np.zeros((0, P, P))
        yield t[[c for c in t.columns if not c.startswith("v")]].assign(**{f"a{i}_{j}": inverse[:, i, j] for i, j in PAIRS})


def with_inverse(estimate: DataFrame) -> DataFrame:
    """An estimate with the inverse of its scatter in place of it."""
    keep = [f"{f.name} {f.dataType.simpleString()}" for f in estimate.schema.fields if not f.name.startswith("v")]
    return estimate.mapInPandas(_inverses, ", ".join([*keep, *(f"a{i}_{j} double" for i, j in PAIRS)]))


def _distance() -> str:
    d = [f"({x} / {SCALE}D - c{i})" for i, x in enumerate(STATS)]
    return " + ".join(f"{d[i]} * {d[j]} * a{i}_{j} * {1 if i == j else 2}D" for i, j in PAIRS)


def _sql(*columns: str) -> list[Column]:
    """Columns of SQL: one call each, as wide tables here would take thousands."""
    return [F.expr(c) for c in columns]


def _median(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The least value up to which half of a key's rows lie, from counted values."""
    up = Window.partitionBy(*keys).orderBy(value)
    all_ = Window.partitionBy(*keys)
    t = counts.withColumn("up", F.sum("n").over(up)).withColumn("all", F.sum("n").over(all_))
    return t.where(F.col("up") * 2 >= F.col("all")).groupBy(*keys).agg(F.min(value).alias("median"))


def _whole(x: str) -> str:
    """A number as so many UNITs, so that sums don't depend on the order of tasks."""
    return f"sum(cast(round({x} * {UNIT}D) AS bigint))"


def _first_estimates(rows: DataFrame) -> DataFrame:
    values = table(rows.select("grp", F.posexplode(F.array(*STATS)).alias("k", "v")).groupBy("grp", "k", "v").agg(F.count("*").alias("n")), "values")
    medians = _median(values, ["grp", "k"], "v")
    off = values.join(medians, ["grp", "k"]).withColumn("d", F.abs(F.col("v") - F.col("median"))).groupBy("grp", "k", "d").agg(F.sum("n").alias("n"))
    spreads = _median(off, ["grp", "k"], "d").withColumnRenamed("median", "spread")
    pick = [f"max(CASE WHEN k = {i} THEN {c} END) AS {c[0]}{i}" for c in ("median", "spread") for i in range(P)]
    middle = table(medians.join(spreads, ["grp", "k"]).groupBy("grp").agg(*_sql(*pick)), "medians")
    near = rows.join(middle, "grp").select("grp", *_sql(*(f"({x} - m{i}) / (1.4826D * s{i} + {FLOOR * SCALE}D) AS z{i}" for i, x in enumerate(STATS))))
    length = " + ".join(f"z{i} * z{i}" for i in range(P))
    near = near.select("*", F.expr(f"sqrt({length} + 1e-9D) AS length")).select("grp", *_sql(*(f"tanh(z{i}) AS t{i}" for i in range(P)), *(f"z{i} / length AS u{i}" for i in range(P))))
    squares = (f"{_whole(f'{c}{i} * {c}{j}')} AS {c}{i}_{j}" for c in "tu" for i, j in PAIRS)
    sums = near.groupBy("grp").agg(*_sql("count(*) AS n", *(f"{_whole(f't{i}')} AS t{i}" for i in range(P)), *squares))
    return table(sums.join(middle, "grp").mapInPandas(_starts, ESTIMATE), "starts")


def _concentrate(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step: location and scatter of the SUPPORT share of each group at the least distances from ``now``."""
    far = rows.join(with_inverse(now), "grp").withColumn("far", F.expr(f"cast(floor(ln(greatest({_distance()}, 1e-6D)) * {BINS * STEPS}) AS int)"))
    of = ["grp", "start"]
    before = Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.ceil(F.lit(SUPPORT) * F.col("n"))

    def up_to(counts: DataFrame, at: str, want: Column) -> DataFrame:
        """The first place of each group at which its rows, counted up, are as many as wanted."""
        t = counts.withColumn("before", F.coalesce(F.sum("m").over(before.orderBy(at)), F.lit(0)))
        return t.where((F.col("before") < want) & (F.col("before") + F.col("m") >= want))

    bins = far.groupBy(*of, "n", F.floor(F.col("far") / STEPS).cast("int").alias("bin")).agg(F.count("*").alias("m"))
    bins = table(up_to(bins, "bin", wanted).select(*of, "bin", "before", "n"), "bins")
    steps = far.drop("n").join(bins, of).where(F.floor(F.col("far") / STEPS) == F.col("bin"))
    steps = steps.groupBy(*of, "far", "n", F.col("before").alias("below")).agg(F.count("*").alias("m"))
    limit = table(up_to(steps, "far", wanted - F.col("below")).select(*of, F.col("far").alias("limit")), "limits")
    totals = (*(f"sum({x}) AS s{i}" for i, x in enumerate(STATS)), *(f"sum(cast({STATS[i]} AS bigint) * {STATS[j]}) AS p{i}_{j}" for i, j in PAIRS))
    sums = far.join(limit, of).where("far <= limit").groupBy(*of, "n", F.col("logdet").alias("was")).agg(*_sql("count(*) AS h", *totals))
    return table(sums.mapInPandas(_concentrated, ESTIMATE), "estimates")


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """Location and scatter of each ``grp`` of ``rows`` of least determinant, and the group's size ``n``.

    Two steps from every start; the start of least determinant goes on until a step lessens it by less than SETTLED.
    """
    now = _first_estimates(rows)
    for _ in range(2):
        now = _concentrate(rows, now)
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    now = table(now.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r").withColumn("done", F.lit(False)), "best")
    settled = now.where("done")
    while not now.isEmpty():
        now = _concentrate(rows, now)
        settled = settled.unionByName(now.where("done"))
        now = table(now.where("not done"), "moving")
    return table(settled.drop("done", "start", "logdet"), "settled")


def _shrunk(own: DataFrame, parent: DataFrame) -> DataFrame:
    """Estimates drawn towards those of their parents, as PRIOR documents of the parent's would, and ``m``: how many documents know as much."""
    names = [*(f"c{i}" for i in range(P)), *(f"v{i}_{j}" for i, j in PAIRS)]
    up = parent.select(*_sql("grp AS up", "m AS up_m", *(f"{c} AS up_{c}" for c in names)))
    both = own.join(up, "up").select("*", *_sql("coalesce(n, 0) AS size", f"coalesce(n, 0) / (coalesce(n, 0) + {PRIOR}D) AS w"))
    knows = "1 / (w * w / greatest(size, 1) + (1 - w) * (1 - w) / up_m) AS m"
    return both.select(*_sql("grp", knows, *(f"coalesce({c}, 0) * w + up_{c} * (1 - w) AS {c}" for c in names)))


def _cutoffs(log_tail: float):
    """Rows of estimates with the inverse of their scatter and the cutoff of their squared distances.

    The distance of a text from an estimate that m texts know as much as is a multiple of an F of P and m - P + 1 degrees; its
    tail of so small a chance is that of the chi-square quantile q, taken through q -> m (exp(q / m) - 1).
    """
    q = chi2_quantile(log_tail, P)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            m = t["m"].to_numpy(float)
            yield t.assign(cutoff=m * np.expm1(np.minimum(q / m, 500)))

    return run


def _levels(lang: str = "lang", source: str = "source") -> tuple[Column, Column, Column]:
    """The groups a text belongs to: all, its language, its language and source."""
    # a null and the string that stands for it here never meet: other strings get a mark in front
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return (F.lit("all"), F.concat_ws("\t", F.lit("1"), name(lang)), F.concat_ws("\t", F.lit("2"), name(lang), name(source)))


def site_estimates(stats: DataFrame, log_tail: float = LOG_TAIL) -> DataFrame:
    """The estimate and the cutoff of each group of ``base_statistics``."""
    levels = _levels()
    good = stats.where(~F.col("base_failed"))
    found = minimum_covariance(good.select(F.explode(F.array(*levels)).alias("grp"), *STATS))
    found = found.select(*_sql("grp", "n", *(f"c{i}" for i in range(P)), *(f"v{i}_{j} * {CONSISTENCY}D AS v{i}_{j}" for i, j in PAIRS)))
    sites = table(stats.select(levels[2].alias("grp"), levels[1].alias("up")).distinct(), "sites")
    whole = found.where("grp = 'all'").withColumn("m", F.col("n").cast("double"))
    # not a constant for the optimizer, which would make a join without a key of it
    langs = sites.select(F.col("up").alias("grp"), F.concat(F.lit("all"), F.substring("up", 1, 0)).alias("up")).distinct()
    langs = table(_shrunk(langs.join(found, "grp", "left"), whole), "languages")
    sites = _shrunk(sites.join(found, "grp", "left"), langs)
    sites = with_inverse(sites).mapInPandas(_cutoffs(log_tail), "grp string, m double, " + ", ".join(f"c{i} double" for i in range(P)) + ", " + ", ".join(f"a{i}_{j} double" for i, j in PAIRS) + ", cutoff double")
    return table(sites, "cutoffs")


def kept_rows(df: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps, with all their columns, whatever those are named.

    Each row is judged by what is in it, beside its group's estimate, so ids play no part; texts are measured twice instead
    of being moved to their verdict. Nulls, repeats and empty tables as there.
    """
    none = df.withColumn(own := _unused(df, "_none"), F.lit(0))
    sites = site_estimates(table(base_statistics(none, own, text, groups), "statistics"))
    names, at = df.columns, df.columns.index(text)
    mark = _unused(df, "_measured")
    inside = ", ".join(("grp: string", "base_failed: boolean", *(f"{c}: int" for c in STATS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b, o in chunks(batch.column(at)):
                m = measure(b, o)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                found = pa.StructArray.from_arrays([batch.column(len(names)).slice(i, j - i), pa.array(failed), *(pa.array(m[c], pa.int32()) for c in STATS)], names=["grp", "base_failed", *STATS])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], found], names=[*names, mark])
        release()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{mark} struct<{inside}>"])
    told = df.select("*", _levels(*groups)[2].alias(_unused(df, "_grp"))).mapInArrow(run, schema).where(~F.col(f"{mark}.base_failed"))
    limits = sites.select(F.col("grp").alias(grp := _unused(df, "_site")), F.struct("cutoff", *(f"c{i}" for i in range(P)), *(f"a{i}_{j}" for i, j in PAIRS)).alias(site := _unused(df, "_estimate")))
    told = told.join(limits, F.col(f"{mark}.grp") == F.col(grp), "left")
    far = re.sub(r"\b([ca][0-9]+(?:_[0-9]+)?)\b", rf"{site}.\1", re.sub(r"\b(x_[a-z]+)\b", rf"{mark}.\1", _distance()))
    outlier = F.coalesce(F.expr(far) > F.col(f"{site}.cutoff"), F.lit(False))
    return told.where(~outlier).select(*(F.col(f"`{c}`") for c in df.columns))


def _unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def quality_rules(df: DataFrame, id: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source"), log_tail: float = LOG_TAIL) -> DataFrame:
    """One row for each row of ``df``: id, ``n_words``, the four other base counts, ``base_failed``, ``kept``, ``distance``
    (squared) and ``cutoff``.

    A null or empty text has no words and fails the base rules. Null languages or sources are groups of their own. Every
    group (language, source) has its own estimate from the texts that pass the base rules, drawn towards its language's,
    and that towards the estimate of all, so that a group of one text is judged too. ``log_tail`` is the logarithm of the
    chance that a text of a Gaussian group lies beyond the cutoff. Repeated rows count each; ids may be null or repeat. Where
    no text passes the base rules, distance and cutoff are null; an empty table gives an empty result.
    """
    stats = table(base_statistics(df, id, text, groups), "statistics")
    sites = site_estimates(stats, log_tail)
    out = stats.withColumn("grp", _levels()[2]).join(sites, "grp", "left").withColumn("distance", F.expr(_distance()))
    outlier = F.coalesce(F.col("distance") > F.col("cutoff"), F.lit(False))
    return out.select(F.col("_id").alias(id), *BASE, "base_failed", (~F.col("base_failed") & ~outlier).alias("kept"), "distance", "cutoff")
