"""A training corpus from ``documents``: quality rules, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), where docs are all rows that its predecessor kept, and returns rows with the
columns of documents; the last returns digests of tokens. Stages tell rows apart by doc_id and all that their verdict
depends on, so that rows which share an id, or have none, each get their own verdict; a missing id loses against any
other. Only mixing goes by doc_id alone: rows that share one are mixed alike. Empty tables pass through, and columns beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import encode
from lectern.llm.exact import exact_dedup
from lectern.llm.mixing import mix
from lectern.llm.near import near_duplicates
from lectern.llm.rules import kept_rows
from lectern.llm.store import table

VOCABULARY = "word_bpe_49k.json"


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _with(docs: DataFrame, verdicts: DataFrame, how: str, by: str = "doc_id") -> DataFrame:
    """Documents with the verdicts on their ids. One shuffle of the texts and no sort: the build side holds ids alone."""
    key = _unused(docs, "_verdict_id")
    found = verdicts.withColumnRenamed(by, key).hint("shuffle_hash")
    return docs.join(found, docs[by].eqNullSafe(found[key]), how)


def _keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """Documents with a digest of their id, text and ``columns``, and its name. A null text is an empty one."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.sha2(F.col(c).cast("string"), 256)), F.lit("-"))
    whole = F.concat_ws(",", part("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256), *map(part, columns))
    return docs.withColumn(key := _unused(docs, "_key"), F.unhex(F.sha2(whole, 256))), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return kept_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id; of rows that repeat both, one."""
    sha, key = _unused(docs, "_sha"), _unused(docs, "_of")
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).hint("shuffle_hash")
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    kept = docs.join(kept, docs["doc_id"].eqNullSafe(kept[key]) & (text == kept[sha]), "left_semi")
    same = Window.partitionBy("doc_id", text).orderBy(F.lit(0))
    number = _unused(docs, "_number")
    return kept.withColumn(number, F.row_number().over(same)).where(F.col(number) == 1).drop(number)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that reach each other by links of near equality, the one of the smallest id."""
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    shared = table(counts.where("n > 1 or doc_id is null").select("doc_id"), "shared")
    if shared.isEmpty():
        kept = near_duplicates(docs).where("component_id = doc_id").select("doc_id")
        return _with(docs, kept, "left_semi")
    # rows that share an id or have none get numbers of their own, beyond all ids; the rule goes by their ids still
    keyed, key = _keyed(docs)
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    numbers = _with(keyed, shared, "left_semi").select(F.col(key).alias("k"), F.col("doc_id").alias("own")).distinct()
    numbers = table(numbers.withColumn("number", F.monotonically_increasing_id() + F.lit(max(most, 0) + 1)), "numbers")
    told = keyed.join(numbers, keyed[key] == numbers["k"], "left").select(F.coalesce("number", "doc_id").alias("number"), "text")
    found = near_duplicates(told, id="number").select("number", "component_id").distinct()
    found = found.join(numbers, "number", "left").withColumn("own", F.when(F.col("k").isNull(), F.col("number")).otherwise(F.col("own")))
    first = Window.partitionBy("component_id").orderBy(F.col("own").asc_nulls_last(), "number")
    kept = found.withColumn("r", F.row_number().over(first)).where("r = 1")
    # rows alone with their id go by it, the others by their digest
    single = kept.where("k is null").select(F.col("number").alias("doc_id"))
    several = kept.where("k is not null").select(F.col("k").alias(key))
    return _with(keyed, single, "left_semi").unionByName(_with(keyed, several, "left_semi", key)).drop(key)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = mix(docs).groupBy("doc_id").agg(F.max("copies").alias(n := _unused(docs, "_copies"))).where(F.col(n) > 0)
    taken = _with(docs, copies, "inner").withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n))))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each row."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path(VOCABULARY), digest=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near duplicates", near), ("mixing", mixed), ("tokens", tokens)]

#: Robust estimates and the mix have no form in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
