"""Collapse runs of equal log lines over tables of log lines.

A stream of lines is one key. Where a bucket is given, runs are found inside ``(key,
bucket)`` with one shuffle and one sort; then the first and last run of each bucket, the
only ones that may go on in a neighbour, are joined in a tree: ``FANOUT`` neighbouring
buckets become one, their inner runs are finished, and two runs at most are handed on. The
runs are the same with any bucket and depth, and with no bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tersely.functions.logs import MIN_RUN, mask_digits, normalise_line, run_marker
from tersely.functions.text import strip, tokens_of_chars

FANOUT, DEPTH = 4096, 2


def line_runs(
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    line_col: str = "line",
    bucket: Column | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per run: keys, ``n``, ``chars``, ``first`` and ``last`` line.

    ``order`` must order the lines of a key totally. ``bucket`` maps a row to
    a whole number that grows with the order, for instance a day or ``line_no div
    100000``; no window holds more than a bucket's lines, or the two runs at the ends of
    ``fanout`` buckets. The last of ``depth`` levels joins what is left of a key: two rows for
    each ``fanout ** (depth - 1)`` buckets. ``chars`` counts a line end per line.
    """
    keys, order = list(keys), list(order)
    places = [f"_o{n}" for n in range(len(order))]
    line = F.struct(*[F.col(c).alias(o) for c, o in zip(order, places)], F.col(line_col).alias("line"))
    pieces = lines.filter(strip(F.col(line_col)) != "").select(
        *keys,
        (F.lit(0) if bucket is None else bucket).cast("long").alias("_part"),
        *[F.col(c).alias(o) for c, o in zip(order, places)],
        F.lit(1).cast("long").alias("n"),
        (F.length(line_col) + 1).cast("long").alias("chars"),
        line.alias("first"),
        line.alias("last"),
        normalise_line(F.col(line_col)).alias("norm"),
    )
    found = _joined(pieces, keys, places)
    finished = []
    for level in range(depth if bucket is not None else 0):
        finished.append(found.filter(~F.col("_edge")))
        group = F.lit(0) if level == depth - 1 else F.expr(f"`_part` div {fanout}")
        ends = found.filter("_edge").withColumn("_from", F.col("_part"))
        found = _joined(ends.withColumn("_part", group.cast("long")), keys, places, "_from")
    runs = reduce(DataFrame.unionByName, [*finished, found])
    named = lambda side: F.struct(
        *[F.col(f"{side}.{o}").alias(c) for c, o in zip(order, places)], F.col(f"{side}.line")
    ).alias(side)
    return runs.select(*keys, "n", "chars", named("first"), named("last"), "norm")


def _joined(pieces: DataFrame, keys: list[str], places: list[str], origin: str | None = None) -> DataFrame:
    """Neighbouring pieces of one ``norm`` joined within ``(keys, _part)``; one shuffle, one sort.

    With ``origin`` only pieces of different origins are neighbours. ``_edge`` marks the first
    and the last run of a part.
    """
    by_place = W.partitionBy(*keys, "_part").orderBy(*places)
    so_far = by_place.rowsBetween(W.unboundedPreceding, 0)

    def goes_on(step) -> Column:
        same = step("norm").over(by_place) == F.col("norm")
        if origin is not None:
            same &= step(origin).over(by_place) != F.col(origin)
        return F.coalesce(same, F.lit(False))

    rows = pieces.select(
        *keys,
        "_part",
        *places,
        "first",
        "last",
        "norm",
        F.sum("n").over(so_far).alias("_n"),
        F.sum("chars").over(so_far).alias("_chars"),
        (F.sum("n").over(so_far) - F.col("n")).alias("_n_before"),
        (F.sum("chars").over(so_far) - F.col("chars")).alias("_chars_before"),
        (~goes_on(F.lag)).alias("_starts"),
        (~goes_on(F.lead)).alias("_ends"),
        F.lag("norm").over(by_place).isNull().alias("_head"),
        F.lead("norm").over(by_place).isNull().alias("_tail"),
    )
    # Of each run its first and last piece are left; the first takes over from the last.
    rows = rows.filter("_starts OR _ends")
    end = lambda name: F.when(F.col("_ends"), F.col(name)).otherwise(F.lead(name).over(by_place))
    rows = rows.select(
        *keys,
        "_part",
        *places,
        "_starts",
        "first",
        end("last").alias("last"),
        "norm",
        (end("_n") - F.col("_n_before")).alias("n"),
        (end("_chars") - F.col("_chars_before")).alias("chars"),
        (F.col("_head") | end("_tail")).alias("_edge"),
    )
    return rows.filter("_starts").drop("_starts")


def collapse_line_runs(
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    line_col: str = "line",
    bucket: Column | None = None,
) -> DataFrame:
    """Lines after collapsing: keys, order of the (first) line, ``n``, ``line``.

    A run of three or more becomes one line; shorter runs keep their lines.
    """
    runs = line_runs(lines, keys, order, line_col, bucket)
    place = lambda side: [F.col(f"{side}.{c}").alias(c) for c in order]
    first = F.struct(*place("first"), F.col("first.line").alias("line"))
    last = F.struct(*place("last"), F.col("last.line").alias("line"))
    marker = F.struct(*place("first"), run_marker(F.col("n"), F.col("norm")).alias("line"))
    out = (
        F.when(F.col("n") >= MIN_RUN, F.array(marker))
        .when(F.col("n") == 2, F.array(first, last))
        .otherwise(F.array(first))
    )
    return runs.select(*keys, "n", F.inline(out))


def run_savings(
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    line_col: str = "line",
    bucket: Column | None = None,
) -> DataFrame:
    """Lines and tokens of each key's log text before and after collapsing."""
    runs = line_runs(lines, keys, order, line_col, bucket)
    long_run = F.col("n") >= MIN_RUN
    chars_after = F.when(
        long_run, F.length(run_marker(F.col("n"), F.col("norm"))) + 1
    ).otherwise(F.col("chars"))
    sums = runs.groupBy(*keys).agg(
        F.sum("n").alias("lines_in"),
        F.sum(F.when(long_run, 1).otherwise(F.col("n"))).alias("lines_out"),
        F.sum("chars").alias("_chars_in"),
        F.sum(chars_after).alias("_chars_out"),
        F.count_if(long_run).alias("runs_collapsed"),
    )
    tokens_in, tokens_out = tokens_of_chars(F.col("_chars_in")), tokens_of_chars(F.col("_chars_out"))
    return sums.select(
        *keys,
        "lines_in",
        "lines_out",
        "runs_collapsed",
        tokens_in.alias("tokens_in"),
        tokens_out.alias("tokens_out"),
        (tokens_in - tokens_out).alias("tokens_saved"),
    )


def repeated_lines(
    lines: DataFrame, keys: Sequence[str], line_col: str = "line", at_least: int = 3
) -> DataFrame:
    """Per key, the number of distinct digit-masked lines seen ``at_least`` times."""
    masked = lines.select(*keys, mask_digits(F.col(line_col)).alias("_masked"))
    counts = masked.filter(F.col("_masked") != "").groupBy(*keys, "_masked").agg(
        F.count("*").alias("_n")
    )
    return counts.groupBy(*keys).agg(F.count_if(F.col("_n") >= at_least).alias("repeated"))
