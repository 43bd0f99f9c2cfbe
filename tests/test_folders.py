"""Streams read a table that is a folder of files as one that is a file."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tersely.plans.queries import QUERIES

STREAMS = (
    "stream_compact_prompts",
    "stream_live_columns",
    "stream_running_metrics",
    "stream_log_runs",
    "stream_chunk_records",
    "stream_chunk_metrics",
)


def tables(spark):
    rows = spark.range(24)
    n = F.col("id")
    return {
        "documents": rows.select(n.alias("doc_id"), F.concat(F.lit("ERROR late "), n).alias("text")),
        "conversations": rows.select(
            F.expr("id div 4").alias("conv_id"),
            (n % 4).cast("int").alias("turn"),
            F.lit("user").alias("role"),
            F.concat(F.lit("text "), n).alias("text"),
        ),
        "events": rows.select(
            n.alias("event_id"),
            F.timestamp_seconds(1_704_067_200 + n * 86_400 * 3).alias("ts"),
            (n % 2).alias("user_id"),
            F.when(n % 6 < 4, "error").otherwise("view").alias("event_type"),
        ),
        "customer": rows.select(n.alias("c_custkey"), F.lit("FURNITURE").alias("c_mktsegment")),
    }


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The same tables as one file each, and as folders of files that are in no order."""
    root = tmp_path_factory.mktemp("stored")
    for name, rows in tables(spark).items():
        rows.repartition(3).write.parquet(f"{root}/folders/{name}.parquet")
        rows.coalesce(1).write.parquet(f"{root}/written/{name}")
        (root / "files").mkdir(exist_ok=True)
        (file,) = (root / "written" / name).glob("*.parquet")
        (root / "files" / f"{name}.parquet").write_bytes(file.read_bytes())
    return root


@pytest.mark.parametrize("name", STREAMS)
def test_stream_over_a_folder(spark, stored, name):
    found = [sorted(map(str, QUERIES[name](spark, f"{stored}/{kind}").collect())) for kind in ("files", "folders")]
    assert found[0] and found[0] == found[1]
