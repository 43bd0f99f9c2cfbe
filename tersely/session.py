"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Days and ISO strings are UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key is legal input: the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Runtime re-planning: coalesced shuffles and split join skew.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; cluster sizing stays with the caller."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession, default: str | None = None) -> str | None:
    """Shared checkpoint folder named by the cluster, else ``default``."""
    return spark.conf.get("spark.checkpoint.dir", None) or default
