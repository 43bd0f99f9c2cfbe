"""Metrics snapshots and baseline tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.operators.reports import metrics_cube, pass_through_reasons
from tersely.schemas import BASELINE, BLOCK, SNAPSHOT, SNAPSHOT_VERSION

COUNTERS = ("attempted", "applied", "pass_through", "tokens_saved")


def snapshot(results: DataFrame, ts_col: str = "ts") -> DataFrame:
    """One row with all counters, recomputed from the results.

    The maps hold one entry per tool, day and reason: aggregates, not rows of
    the results.
    """
    cube = metrics_cube(results, ts_col).select(
        "scope", F.coalesce("tool", F.col("day").cast("string")).alias("key"), *COUNTERS
    )
    reasons = pass_through_reasons(results).select(
        F.lit("reason").alias("scope"),
        F.col("reason").alias("key"),
        F.col("n").alias("attempted"),
        *[F.lit(0).cast("long").alias(name) for name in COUNTERS[1:]],
    )
    return _assembled(cube.unionByName(reasons))


def _assembled(counters: DataFrame) -> DataFrame:
    """The snapshot of rows (scope, key, counters), one for each scope and key."""
    block = F.struct("attempted", "applied", "pass_through", F.col("tokens_saved").alias("delta"))
    entries = lambda scope, value: F.map_from_entries(
        F.collect_list(F.when(F.col("scope") == scope, F.struct("key", value)))
    )
    total = lambda name: F.coalesce(
        F.max(F.when(F.col("scope") == "total", F.col(name))), F.lit(0).cast("long")
    )
    return counters.agg(
        F.lit(SNAPSHOT_VERSION).cast("long").alias("schema_version"),
        total("attempted").alias("transforms_attempted"),
        total("applied").alias("transforms_applied"),
        total("pass_through").alias("pass_through"),
        total("tokens_saved").alias("estimated_token_delta_total"),
        entries("reason", F.col("attempted")).alias("pass_through_reasons"),
        entries("tool", block).alias("by_tool"),
        entries("day", block).alias("daily"),
    )


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """The counters of snapshots as rows: scope (total, tool, day, reason), key and four numbers."""

    def row(scope: str, key: Column, *numbers: Column) -> Column:
        named = [n.cast("long").alias(name) for n, name in zip(numbers, COUNTERS)]
        return F.struct(F.lit(scope).alias("scope"), key.cast("string").alias("key"), *named)

    def blocks(scope: str, column: str) -> Column:
        fields = ("attempted", "applied", "pass_through", "delta")
        return F.transform(
            F.map_entries(column), lambda e: row(scope, e["key"], *[e["value"][f] for f in fields])
        )

    totals = ("transforms_attempted", "transforms_applied", "pass_through", "estimated_token_delta_total")
    zero = F.lit(0)
    listed = F.concat(
        F.array(row("total", F.lit(None), *map(F.col, totals))),
        blocks("tool", "by_tool"),
        blocks("day", "daily"),
        F.transform(
            F.map_entries("pass_through_reasons"), lambda e: row("reason", e["key"], e["value"], zero, zero, zero)
        ),
    )
    return snapshots.select(F.inline(listed))


def folded(snapshots: DataFrame) -> DataFrame:
    """One snapshot of all rows of ``snapshots`` together: counters add up, in any order."""
    sums = [F.sum(name).alias(name) for name in COUNTERS]
    return _assembled(snapshot_rows(snapshots).groupBy("scope", "key").agg(*sums))


def current_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot kept by ``update_snapshot`` with its ``slot`` and ``last_batch``.

    Damaged parts are dropped as in ``read_snapshot``; without a readable one all counters are 0
    and ``last_batch`` is -1.
    """
    try:
        stored = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], "value string, slot int")
    number = F.get_json_object("value", "$.last_batch").try_cast("long")
    none = spark.createDataFrame([("", -1)], "value string, slot int")
    rows = stored.select("value", F.col("slot").cast("int").alias("slot")).unionByName(none)
    rows = rows.withColumn("last_batch", F.coalesce(number, F.lit(-1)))
    latest = rows.orderBy(F.desc("last_batch"), F.desc("slot")).limit(1)
    return latest.select(*_clean_columns(), "slot", "last_batch")


def update_snapshot(results: DataFrame, path: str, batch_id: int, ts_col: str = "ts") -> bool:
    """Fold the counters of a batch of results into the snapshot kept below ``path``.

    Returns whether it did: a batch whose number is not above the last one is already in and changes
    nothing, so a repeated micro-batch counts once. Two slots take turns: the new state goes
    to the one that does not hold the current state, which stays readable until the
    new one is complete.
    """
    spark = results.sparkSession
    held = current_snapshot(spark, path).first()  # one row of aggregates
    if batch_id <= held.last_batch:
        return False
    names = [f.name for f in spark.createDataFrame([], SNAPSHOT).schema]
    before = spark.createDataFrame([tuple(held[name] for name in names)], SNAPSHOT)
    after = folded(before.unionByName(snapshot(results, ts_col)))
    after = after.withColumn("last_batch", F.lit(batch_id).cast("long"))
    write_snapshot(after, f"{path}/slot={1 - max(held.slot, 0)}")
    return True


def write_snapshot(snap: DataFrame, path: str) -> None:
    """Replace the stored snapshot."""
    snap.write.mode("overwrite").json(path)


def _clean_total(raw: Column) -> Column:
    number = F.when(raw.rlike(r"^\d+$"), raw.try_cast("long"))
    return F.coalesce(number, F.lit(0).cast("long"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshot with damaged parts dropped; unreadable text gives zeros.

    Totals that are not whole numbers, or are negative, become 0. A counter
    block needs four whole numbers, all but ``delta`` not negative.
    """
    return spark.read.text(path, wholetext=True).select(*_clean_columns())


def _clean_columns() -> list[Column]:
    """The columns of a snapshot from its text ``value``."""
    loose = "map<string,string>"
    top = F.from_json("value", loose)
    whole = r"^-?\d+$"

    def blocks(raw: Column) -> Column:
        parsed = F.transform_values(
            F.from_json(raw, loose), lambda key, value: F.from_json(value, loose)
        )
        names = ("attempted", "applied", "pass_through", "delta")

        def sound(key: Column, value: Column) -> Column:
            ok = value.isNotNull()
            for name in names:
                field = F.try_element_at(value, F.lit(name))
                pattern = whole if name == "delta" else r"^\d+$"
                ok = ok & F.coalesce(field.rlike(pattern), F.lit(False))
            return ok

        kept = F.map_filter(parsed, sound)
        typed = F.transform_values(
            kept,
            lambda key, value: F.struct(
                *[F.try_element_at(value, F.lit(n)).try_cast("long").alias(n) for n in names]
            ),
        )
        return F.coalesce(typed, F.create_map().cast(f"map<string,{BLOCK}>"))

    get = lambda name: F.try_element_at(top, F.lit(name))
    reasons = F.transform_values(
        F.map_filter(
            F.from_json(get("pass_through_reasons"), loose),
            lambda key, value: F.coalesce(value.rlike(r"^\d+$"), F.lit(False)),
        ),
        lambda key, value: value.try_cast("long"),
    )
    return [
        F.lit(SNAPSHOT_VERSION).cast("long").alias("schema_version"),
        _clean_total(get("transforms_attempted")).alias("transforms_attempted"),
        _clean_total(get("transforms_applied")).alias("transforms_applied"),
        _clean_total(get("pass_through")).alias("pass_through"),
        _clean_total(get("estimated_token_delta_total")).alias("estimated_token_delta_total"),
        F.coalesce(reasons, F.create_map().cast("map<string,long>")).alias("pass_through_reasons"),
        blocks(get("by_tool")).alias("by_tool"),
        blocks(get("daily")).alias("daily"),
    ]


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Baseline figures per fixture."""
    return spark.read.schema(BASELINE).json(path)


def write_baseline(current: DataFrame, path: str) -> None:
    """Replace the baseline by the current figures."""
    current.write.mode("overwrite").json(path)
