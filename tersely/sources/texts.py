"""Documents from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(
    spark: SparkSession, path: str, suffix: str | None = None, recursive: bool = True
) -> DataFrame:
    """One document per file: ``(path, text)``."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if suffix is not None:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_text_stream(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """Files that arrive under a path, one document each."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if suffix is not None:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )
