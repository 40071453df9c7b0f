"""Findings of a stream of documents: every rule looks at one document, so the batch plan runs on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectern.config import Config
from lectern.plans.lint import analyze, findings


def lint_stream(stream: DataFrame, config: Config | None = None, **options) -> DataFrame:
    """Findings of a streaming DataFrame; stateless, so it may be appended to any sink."""
    return findings(analyze(stream, config, **options))


def run_available(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, config: Config | None = None, **options) -> StreamingQuery:
    """Lints all Parquet files that are in ``folder`` and not yet done, exactly once, into Parquet files in ``out``."""
    found = lint_stream(spark.readStream.schema(schema).parquet(folder), config, **options)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
