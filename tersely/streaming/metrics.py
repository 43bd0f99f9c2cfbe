"""Running metrics and audit rows over streams of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tersely.functions.text import tool_label
from tersely.sources.audit_log import STORED


def running_metrics(
    results: DataFrame, ts_col: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Counters per UTC day and tool, updated as results arrive.

    State is one row per open day and tool; days older than the watermark
    are dropped from it.
    """
    applied = F.col("transformed")
    saved = F.when(applied, F.col("input_tokens") - F.col("output_tokens")).otherwise(0)
    counted = (
        results.withColumn("tool", tool_label(F.col("tool")))
        .withWatermark(ts_col, delay)
        .groupBy(F.window(ts_col, "1 day").alias("_window"), "tool")
        .agg(
            F.count("*").alias("attempted"),
            F.count_if(applied).alias("applied"),
            F.count_if(~applied).alias("pass_through"),
            F.sum(saved).alias("tokens_saved"),
        )
    )
    return counted.select(
        F.to_date("_window.start").alias("day"),
        "tool",
        "attempted",
        "applied",
        "pass_through",
        "tokens_saved",
    )


def read_audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Audit records as they are appended."""
    return spark.readStream.schema(STORED).json(path).drop("append")


def append_audit_stream(audit: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of audit records under one folder per day, exactly once."""
    days = audit if "day" in audit.columns else audit.withColumn("day", F.substring("ts", 1, 10))
    return (
        days.writeStream.format("json")
        .option("path", path)
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
