"""Audit and event records: build, append, read, filter."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.functions.text import audit_hash, content_hash, redact_assignments, tool_label
from tersely.schemas import AUDIT

STORED = AUDIT + ", day string, append long"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
DEFAULT_TAIL = 50


def iso_time(ts: Column) -> Column:
    """UTC timestamp as ISO text."""
    return F.regexp_replace(F.date_format(ts, ISO), "Z$", "+00:00")


def audit_rows(
    results: DataFrame,
    tool: Column,
    ts: Column,
    version: str,
    session_id: str,
    duration_ms: Column | None = None,
    text_col: str = "text",
) -> DataFrame:
    """Audit records of compaction results; the hash is of the redacted text."""
    took = F.lit(0) if duration_ms is None else duration_ms
    return results.select(
        iso_time(ts).alias("ts"),
        F.lit(version).alias("version"),
        tool_label(tool).alias("tool"),
        "action",
        "reason",
        "estimator",
        audit_hash(F.col(text_col)).alias("input_hash"),
        F.col("input_tokens").cast("long").alias("input_tokens_est"),
        F.col("output_tokens").cast("long").alias("output_tokens_est"),
        (F.col("output_tokens") - F.col("input_tokens")).cast("long").alias("delta_tokens"),
        took.cast("long").alias("duration_ms"),
        F.lit(session_id).alias("session_id"),
    )


def event_rows(
    results: DataFrame, ts: Column, redaction: bool = True, text_col: str = "text"
) -> DataFrame:
    """Event records of compaction results; no hash when redaction is off."""
    digest = content_hash(redact_assignments(F.col(text_col)))
    return results.select(
        iso_time(ts).alias("ts"),
        F.lit("transform").alias("type"),
        "action",
        "reason",
        F.col("input_tokens").cast("long").alias("input_tokens"),
        F.col("output_tokens").cast("long").alias("output_tokens"),
        (digest if redaction else F.lit(None).cast("string")).alias("prompt_hash"),
        F.transform("segments", lambda s: s["kind"]).alias("segment_types"),
        "transformed",
    )


def append_records(records: DataFrame, path: str, enabled: bool = True) -> None:
    """Append JSON lines under one folder per day and append; fields in key order.

    Nulls are written out, so every record has all its fields. Appends are numbered by the
    time they begin, so that records have an order over all files.
    """
    if not enabled:
        return
    ordered = records.select(
        *sorted(records.columns),
        F.substring("ts", 1, 10).alias("day"),
        F.lit(time.time_ns() // 1000).alias("append"),
    )
    (
        ordered.write.mode("append")
        .option("ignoreNullFields", False)
        .partitionBy("day", "append")
        .json(path)
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit records with day and append; a bad line raises, a missing path holds none."""
    schema = STORED
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def filter_audit(
    audit: DataFrame,
    since_prefix: str | None = None,
    tool: str | None = None,
) -> DataFrame:
    """Records whose time starts with a prefix, of one tool.

    A prefix that covers a whole day also prunes the day folders.
    """
    if since_prefix:
        audit = audit.filter(F.startswith(F.col("ts"), F.lit(since_prefix)))
        if "day" in audit.columns:
            day = since_prefix[:10]
            audit = audit.filter(F.startswith(F.col("day"), F.lit(day)))
    if tool:
        audit = audit.filter(F.col("tool") == tool)
    return audit


def tail_audit(audit: DataFrame, n: int = DEFAULT_TAIL, by_time: bool = False) -> DataFrame:
    """The last ``n`` records, oldest first. Top-k, not a full sort.

    ``audit`` is ``read_audit``, filtered or not: records follow each other as in the files, by
    append, file and place in the file. ``by_time`` orders by ``ts`` instead, ties by hash and
    action, as is needed for records that come from no file.
    """
    if by_time:
        ties = [c for c in ("input_hash", "action") if c in audit.columns]
        last = audit.orderBy(F.col("ts").desc(), *[F.col(c).desc() for c in ties]).limit(n)
        return last.orderBy("ts", *ties)
    # Row numbers grow within a task, and a block of a file is read by one task in order.
    place = F.struct(
        "append",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    last = audit.withColumn("_place", place).orderBy(F.col("_place").desc()).limit(n)
    return last.orderBy("_place").drop("_place")
