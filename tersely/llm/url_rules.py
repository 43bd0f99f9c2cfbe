"""URL filters by a sort-merge range join with a sorted sweep.

A rule is a host and a path prefix. Its canonical key is the host's labels in reverse,
then the path, so all keys that begin with it form an interval, and intervals of two
rules nest or are apart. A page gives one point for each host suffix that a rule could
name; a rule fits if the point lies in its interval.

Points and interval starts are cut into key ranges of about equal size, sorted, and
swept: a rule carries the stack of the rules that are open where it begins (itself and
those around it), the sweep hands the last stack on to the points behind it, and a
point takes off the entries whose interval has ended. A range begins with the rules
that are open at its border. The longest rule over all points of a page wins.

Ranges come from a sample of fixed size per range (the ``SAMPLE`` smallest hashes), and
equal keys are told apart by a hash of the row, so a host with any share of the pages
is spread over many ranges. Only splits and the greatest number of labels of a rule
come to the driver. All steps are DataFrame functions.

A null url, or one without ``://``, has an empty host and path and fits no rule. Each
row is judged by itself, so ids may repeat or be null. Of rules that agree in host and
path, block wins. An empty rule table leaves the default verdict.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES_PER_PARTITION = 4
SAMPLE = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "action string, host string, path string"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered, and path; both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")
    )


def suffix_key(labels: Column, n: Column) -> Column:
    """The last ``n`` labels in reverse order."""
    return F.array_join(F.slice(F.reverse(labels), 1, n), ".")


def stacks(rules: DataFrame) -> DataFrame:
    """key and stack of each rule: the rules around it, outermost first, then itself."""
    labels = F.split(lower_ascii(F.col("host")), "\\.")
    one = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .select(suffix_key(labels, F.size(labels)).alias("name"), "path", "action",
                lower_ascii(F.col("host")).alias("host"))
        .groupBy("name", "host", "path")
        .agg(F.max("action").alias("action"))
    )
    prefixes = one.select(
        "name",
        F.col("path").alias("of"),
        F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("path"),
    )
    entry = F.struct(F.length("path").alias("size"), "name", "host", "path", "action")
    return (
        prefixes.join(one, ["name", "path"])
        .groupBy("name", "of")
        .agg(F.sort_array(F.collect_list(entry)).alias("stack"))
        .select(point_key(F.col("name"), F.col("of")).alias("place"), "stack")
    )


def point_key(name: Column, path: Column) -> Column:
    return F.concat(name, F.lit("\u0001"), path)


def range_of(place: Column, splits: list[str]) -> Column:
    """Number of the range that holds ``place``, by a search in two steps."""
    if not splits:
        return F.lit(0)
    width = math.isqrt(len(splits)) + 1
    every, coarse = F.lit(splits), F.lit(splits[::width])
    step = F.size(F.filter(coarse, lambda s: s <= place))
    near = F.slice(every, (step - 1) * width + 1, width)
    return F.when(step == 0, 0).otherwise(
        (step - 1) * width + F.size(F.filter(near, lambda s: s <= place))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that wins, or null) and verdict.

    Columns of these names that ``pages`` has already are replaced. Select the columns
    you need first: all of them travel with the rows.
    """
    spark = pages.sparkSession
    pages = pages.drop(*({"host", "path", "rule", "verdict"} - {url_col}))
    host, path = host_and_path(F.col(url_col))
    row = F.struct(*pages.columns)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_id"), row.alias("row"), host.alias("host"), path.alias("path")
    )
    most = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 1
    labels = F.split("host", "\\.")
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most)))
    points = rows.select(
        "row_id", "row", "host", "path", F.explode(levels).alias("level")
    ).select(
        "row_id",
        F.when(F.col("level") == 1, F.col("row")).alias("row"),
        F.when(F.col("level") == 1, F.col("host")).alias("host"),
        "path",
        suffix_key(labels, F.col("level")).alias("name"),
    )
    mark = F.hex(F.xxhash64("row_id"))
    points = points.withColumn(
        "place", F.concat(point_key(F.col("name"), F.col("path")), F.lit("\u0001"), mark)
    )
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # What comes to the driver depends on the number of ranges, not on rows or tasks: hashes
    # below a bound that follows from the number of points.
    wanted, total = ranges * SAMPLE, rows.agg(F.sum(F.size(levels))).first()[0] or 0
    drawn = points.select("place")
    if total > wanted:
        drawn = drawn.where(F.xxhash64("place") < int(2.0**64 * wanted / total) - 2**63)
    places = sorted((r.place for r in drawn.collect()), key=lambda s: s.encode())
    splits = sorted({places[i] for i in range(SAMPLE, len(places), SAMPLE)}, key=lambda s: s.encode())

    ruled = stacks(rules)
    open_at = F.lit(splits) if splits else F.array().cast("array<string>")
    begins = F.transform(open_at, lambda s, i: F.when(F.startswith(s, F.col("place")), i + 1))
    in_ranges = F.array_union(
        F.array(range_of(F.col("place"), splits).cast("int")), F.array_compact(begins)
    )
    none = {name: F.lit(None).cast(kind) for name, kind in points.dtypes if name != "place"}
    starts = ruled.select(
        *(none[c].alias(c) for c in points.columns if c != "place"),
        "place",
        F.explode(in_ranges).alias("range"),
        "stack",
    )
    swept = Window.partitionBy("range").orderBy("place", F.col("row_id").isNotNull())
    so_far = swept.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = (
        points.withColumn("range", range_of(F.col("place"), splits).cast("int"))
        .withColumn("stack", F.lit(None).cast(ruled.schema["stack"].dataType))
        .unionByName(starts)
        .withColumn("stack", F.last("stack", ignorenulls=True).over(so_far))
        .where("row_id IS NOT NULL")
    )
    still_open = F.filter(
        "stack", lambda s: (s["name"] == F.col("name")) & F.startswith(F.col("path"), s["path"])
    )
    best = F.try_element_at(still_open, F.lit(-1))
    ranked = F.when(
        best.isNotNull(),
        F.struct(
            (F.length(best["host"]) + best["size"]).alias("size"),
            F.concat(best["host"], best["path"]).alias("rule"),
            best["action"].alias("action"),
        ),
    )
    judged = (
        met.withColumn("best", ranked)
        .groupBy("row_id")
        .agg(
            F.first("row", ignorenulls=True).alias("row"),
            F.first("host", ignorenulls=True).alias("host"),
            F.first("path").alias("path"),
            F.max("best").alias("best"),
        )
    )
    return judged.select(
        "row.*",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
