"""Author profiles: rates and rhythm over a corpus, and the distance of a text from one.

The only aggregation across documents. Authors are groups; words are counted in each partition first. Function words
are those of a list of our own (``FUNCTION_WORDS``); sections that need a tagger are left out, and null.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.reading import SUMS, told
from lectern.functions.tables import CONNECTORS, FUNCTION_WORDS, PUNCTUATION

BLOCK = 1000
#: section: entries kept
TOP = {"function_words": 60, "openers": 15, "bigrams": 25}
DELTA_WORDS, LEAST_BLOCKS = 100, 5


def _top(counts: DataFrame, limit: int, name: str, key: str = "word") -> DataFrame:
    """The most frequent entries of each author as a map of counts; equals by first appearance, then by name."""
    order = Window.partitionBy("author").orderBy(F.desc("n"), "first", key)
    kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    return kept.groupBy("author").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(key).alias("k"), F.col("n").alias("v")))), lambda x: F.struct(x["k"], x["v"]))).alias(name))


def _rate(per: str):
    return lambda _, n: n * F.lit(1000.0) / F.greatest(F.col(per), F.lit(1))


def prepare(df: DataFrame, text: str, author: Column, id: str, reads: tuple[str, ...] = ("sums", "n_tokens", "places", "openings", "connectors", "bigrams")) -> DataFrame:
    """A row a document with what is read of its sentences and words."""
    df = df.select(author.alias("author"), F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return df.withColumn("_told", told(F.col("_text"), reads)).select("author", "id", *(F.col(f"_told.{x}").alias(x) for x in reads))


def _cv(n: str, s: str, q: str) -> Column:
    a, b, c = (F.col(x).cast("double") for x in (n, s, q))
    return F.when((a >= 2) & (b > 0), F.sqrt(a * c - b * b) / b).otherwise(F.lit(0.0))


def rhythm(docs: DataFrame) -> DataFrame:
    """Of each author the corpus, rhythm and punctuation."""
    sums = docs.groupBy("author").agg(F.count("*").alias("docs"), *(F.sum(F.get("sums", F.lit(i))).alias(k) for i, k in enumerate(SUMS)))
    per = lambda x: F.when(F.col("n_words") > 0, F.col(x) * F.lit(1000.0) / F.col("n_words")).otherwise(0.0)
    least = lambda x: F.greatest(F.col(x), F.lit(1)).cast("double")
    return sums.select(
        "author", "docs", F.col("n_words").alias("words"), F.col("n_sentences").alias("sentences"), (F.col("l_s") / least("l_n")).alias("sentence_mean"), _cv("l_n", "l_s", "l_q").alias("sentence_cv"), _cv("g_n", "g_s", "g_q").alias("segment_cv"),
        (F.col("p_s") / least("p_n")).alias("paragraph_mean_sentences"), _cv("p_n", "p_s", "p_q").alias("paragraph_cv"), (F.col("punchlines") / least("p_n")).alias("punchline_ending_share"), F.create_map(*(x for k in sorted(PUNCTUATION) for x in (F.lit(k), per(f"mark_{k}")))).alias("punctuation"),
    )


def _placed(docs: DataFrame) -> DataFrame:
    """author, id, pos, word of all function words."""
    return docs.select("author", "id", F.explode("places").alias("p")).select("author", "id", "p.pos", "p.word")


def function_counts(docs: DataFrame) -> DataFrame:
    """author, word, n, first: function words, and the least (id, place) at which each stands."""
    return _placed(docs).groupBy("author", "word").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))


def opener_counts(docs: DataFrame, connectors: bool = False) -> DataFrame:
    """author, word, n, first: first words of sentences, or the connectors that open them."""
    opened = docs.select("author", "id", F.explode("connectors").alias("o")).select("author", "id", "o.pos", "o.word") if connectors else docs.select("author", "id", F.posexplode("openings").alias("pos", "o")).select("author", "id", "pos", F.get("o", F.lit(0)).alias("word"))
    return opened.groupBy("author", "word").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))


def bigram_counts(docs: DataFrame) -> DataFrame:
    """Pairs of adjacent words, not both function words, that recur in at least max(2, a quarter) of an author's documents."""
    rows = docs.select("author", "id", F.explode("bigrams").alias("p")).select("author", "id", "p.word", "p.n", "p.pos")
    by_doc = rows.groupBy("author", "id", "word").agg(F.sum("n").alias("n"), F.min("pos").alias("pos"))
    counts = by_doc.groupBy("author", "word").agg(F.sum("n").alias("n"), F.count("*").alias("docs_with"), F.min(F.struct("id", "pos")).alias("first"))
    docs_of = docs.groupBy("author").agg(F.count("*").alias("docs"))
    return counts.join(docs_of, "author").where(F.col("docs_with") >= F.greatest(F.lit(2), F.floor(F.col("docs") / 4))).drop("docs", "docs_with")


def delta_blocks(docs: DataFrame) -> DataFrame:
    """author, block, word, rate: function words a thousand words, over blocks of the author's words in order of id.

    Only counts of documents are put in order, one row each, within an author.
    """
    up = Window.partitionBy("author").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.select("author", "id", F.col("n_tokens").alias("k")).withColumn("start", F.coalesce(F.sum("k").over(up), F.lit(0))).drop("k")
    totals = docs.groupBy("author").agg(F.sum("n_tokens").alias("total"))
    placed = _placed(docs).join(starts, ["author", "id"]).join(totals, "author").withColumn("block", F.floor((F.col("start") + F.col("pos")) / BLOCK))
    size = F.least(F.lit(BLOCK), F.col("total") - F.col("block") * BLOCK)
    return placed.withColumn("size", size).where(F.col("size") >= BLOCK // 2).groupBy("author", "block", "word", "size").agg(F.count("*").alias("n")).select("author", "block", "word", (F.col("n") * F.lit(float(BLOCK)) / F.col("size")).alias("rate"))


def delta_stats(docs: DataFrame) -> DataFrame:
    """author, word, blocks, mean, std of the most frequent function words; authors of fewer than five blocks have none."""
    sizes = docs.groupBy("author").agg(F.sum("n_tokens").alias("total")).select("author", (F.floor(F.col("total") / BLOCK) + F.when(F.col("total") % BLOCK >= BLOCK // 2, 1).otherwise(0)).alias("blocks"))
    order = Window.partitionBy("author").orderBy(F.desc("n"), "first", "word")
    common = function_counts(docs).withColumn("r", F.row_number().over(order)).where(F.col("r") <= DELTA_WORDS).select("author", "word")
    sums = delta_blocks(docs).join(common, ["author", "word"]).groupBy("author", "word").agg(F.sum("rate").alias("s"), F.sum(F.col("rate") * F.col("rate")).alias("q"))
    # blocks without the word count as zero
    mean, square = F.col("s") / F.col("blocks"), F.col("q") / F.col("blocks")
    out = sums.join(sizes, "author").where(F.col("blocks") >= LEAST_BLOCKS).select("author", "word", "blocks", mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))
    return out.where("std > 0")


def build_profiles(df: DataFrame, text: str = "text", author: str | None = None, id: str = "doc_id") -> DataFrame:
    """One row for each author: corpus, rhythm, punctuation and the maps of rates. Without ``author`` all is one author's."""
    # two readings of the texts: the pairs, which are many, and all else, which is small and kept on disk for the other sections
    of = lambda *reads: prepare(df, text, F.col(author) if author else F.lit("all"), id, reads)
    docs = of("sums", "n_tokens", "places", "openings", "connectors").persist(StorageLevel.DISK_ONLY)
    base = rhythm(docs)
    sections = [
        _top(function_counts(docs), TOP["function_words"], "function_words"), _top(opener_counts(docs), TOP["openers"], "openers"), _top(opener_counts(docs, True), len(CONNECTORS), "connectors"), _top(bigram_counts(of("bigrams")), TOP["bigrams"], "bigrams"),
        delta_stats(docs).groupBy("author").agg(F.max("blocks").alias("delta_blocks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", F.struct("mean", "std"))))).alias("delta")),
    ]
    for s in sections:
        base = base.join(s, "author", "left")
    for name, per in (("function_words", "words"), ("openers", "sentences"), ("connectors", "sentences"), ("bigrams", "words")):
        base = base.withColumn(name, F.transform_values(name, _rate(per)))
    return base


def as_style(row) -> dict:
    """One row of ``build_profiles`` as the profile that ``Config.style`` takes. Bounded: it holds only the top entries."""
    r = row.asDict(recursive=True)
    out = {
        "name": r["author"], "corpus": {k: r[k] for k in ("docs", "words", "sentences")}, "rhythm": {k: r[k] for k in ("sentence_mean", "sentence_cv", "segment_cv", "paragraph_mean_sentences", "paragraph_cv", "punchline_ending_share")},
        "punctuation_per_1000_words": r["punctuation"], "function_words_per_1000": r["function_words"] or {}, "sentence_openers_per_1000_sentences": r["openers"] or {}, "connectors_per_1000_sentences": r["connectors"] or {}, "favorite_bigrams_per_1000": r["bigrams"] or {},
    }
    if r["delta"]:
        out["delta"] = {"chunk_words": BLOCK, "chunks": r["delta_blocks"], "words": {w: [s["mean"], s["std"]] for w, s in r["delta"].items()}}
    return out


def profile_card(p: dict) -> str:
    """A profile in words."""
    c, r = p["corpus"], p["rhythm"]
    first = lambda d, n: ", ".join(f"{k} ({v:.2f})" for k, v in list(d.items())[:n])
    lines = [f"# {p['name']}", f"{c['docs']} texts, {c['words']} words, {c['sentences']} sentences"]
    if c["words"] < 10_000:
        lines.append("A small corpus: rates are noisy.")
    lines.append(f"Rhythm: {r['sentence_mean']:.1f} words a sentence (variation {r['sentence_cv']:.2f}), segments {r['segment_cv']:.2f}; {r['paragraph_mean_sentences']:.1f} sentences a paragraph (variation {r['paragraph_cv']:.2f}), {r['punchline_ending_share']:.0%} close on a short beat")
    lines.append("Marks a 1000 words: " + first({k: v for k, v in p["punctuation_per_1000_words"].items() if v}, 9))
    lines += [f"Connectors: {first(p['connectors_per_1000_sentences'], 12)}", f"Openers: {first(p['sentence_openers_per_1000_sentences'], 12)}", f"Pairs: {first(p['favorite_bigrams_per_1000'], 15)}"]
    if "delta" in p:
        lines.append(f"Function-word baseline over {p['delta']['chunks']} blocks of {p['delta']['chunk_words']} words")
    return "\n".join(lines) + "\n"


def trigram_divergence(mine: DataFrame, theirs: DataFrame, id: str = "doc_id") -> DataFrame:
    """Base-2 Jensen-Shannon divergence of each document's trigram counts (id, trigram, n) from a profile's (trigram, share).

    Counts come from whatever tagger the user has; the profile is renormalised. Trigrams that a document lacks add
    half their share, which is summed once and not joined for each document.
    """
    norm = theirs.agg(F.sum("share").alias("t")).first()["t"] or 1.0
    p = theirs.select("trigram", (F.col("share") / F.lit(float(norm))).alias("p"))
    total = mine.groupBy(id).agg(F.sum("n").alias("total"))
    q = mine.join(total, id).withColumn("q", F.col("n") / F.col("total")).join(p, "trigram", "left")
    pp, m = F.coalesce("p", F.lit(0.0)), (F.coalesce("p", F.lit(0.0)) + F.col("q")) / 2
    term = F.lit(0.5) * F.col("q") * F.log2(F.col("q") / m) + F.when(pp > 0, F.lit(0.5) * pp * F.log2(pp / m)).otherwise(0.0)
    sums = q.groupBy(id).agg(F.sum(term).alias("shared"), F.sum(pp).alias("covered"))
    # a trigram with q = 0 contributes p/2 * log2(p / (p/2)) = p/2
    return sums.select(id, (F.col("shared") + (F.lit(1.0) - F.col("covered")) / 2).alias("divergence"))
