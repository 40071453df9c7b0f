"""Tables written in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again; a lost executor costs nothing of it. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern/{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at.getParent(), True)
        except Exception:  # the JVM may be gone already
            return
