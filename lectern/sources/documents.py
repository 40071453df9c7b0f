"""Documents from files, and findings to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKDOWN, HTML, TEXT = ("md", "markdown", "mdown", "mkd"), ("html", "htm", "xhtml"), ("txt", "text", "rst")


def kind_of(name: Column) -> Column:
    """text, markdown or html, by the suffix of a name."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.when(suffix.isin(*MARKDOWN), "markdown").when(suffix.isin(*HTML), "html").otherwise("text")


def read_files(spark: SparkSession, path: str, every_suffix: bool = False) -> DataFrame:
    """``doc_id, name, kind, text`` of each file below ``path``, in UTF-8, without a byte-order mark. A missing path is Spark's error.

    Without ``every_suffix`` only text, Markdown and HTML files. The id is a hash of the name.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    df = reader.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.regexp_replace("value", "^﻿", "").alias("text"))
    if not every_suffix:
        df = df.where(F.lower(F.regexp_extract("name", r"\.([^./\\]+)$", 1)).isin(*MARKDOWN, *HTML, *TEXT))
    return df.select(F.xxhash64("name").alias("doc_id"), "name", kind_of(F.col("name")).alias("kind"), "text")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, if a scan gives fewer: rules are narrow, so a file of one row group would
    keep one core busy. Texts move once; a scan of many splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_text(spark: SparkSession, text: str, name: str = "-") -> DataFrame:
    """One document from memory, its kind by the name."""
    return spark.createDataFrame([(0, name, text)], "doc_id bigint, name string, text string").withColumn("kind", kind_of(F.col("name")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Report lines as text files."""
    lines.select("value").write.mode("overwrite").text(path)
