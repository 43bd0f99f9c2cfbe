"""Spread costly rows over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str | Column) -> DataFrame:
    """``df`` hash-partitioned by a unique key over all shuffle partitions.

    The number is given, so small partitions are not merged by their size in
    bytes: what follows is costly per byte and multiplies the rows.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, key)


def spread_rows(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` spread by the content of ``cols``, before its rows are worked on one by one.

    A file of few row groups is few tasks, however many rows it has.
    """
    return spread(df, F.xxhash64(*cols))
