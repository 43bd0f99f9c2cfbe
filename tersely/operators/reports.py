"""Token budgets, totals, metrics, regression check and line differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.line_diff import kept_pairs
from tersely.functions.text import (
    compression_ratio,
    delta_percent,
    estimate_tokens,
    split_lines,
    tool_label,
)

# --- fixed values -----------------------------------------------------------
TOLERANCE_PERCENT = 5.0
MAX_RULES = 8
# ----------------------------------------------------------------------------


def budget_violations(
    documents: DataFrame, max_tokens: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents whose estimate exceeds the budget."""
    tokens = estimate_tokens(F.col(text_col))
    return documents.select(id_col, tokens.alias("tokens")).filter(F.col("tokens") > max_tokens)


def within_budget(documents: DataFrame, max_tokens: int, text_col: str = "text") -> bool:
    """True if no document exceeds the budget; stops at the first that does."""
    return documents.filter(estimate_tokens(F.col(text_col)) > max_tokens).isEmpty()


def token_totals(
    sizes: DataFrame,
    keys: Sequence[str] = (),
    tokens_in: str = "input_tokens",
    tokens_out: str = "output_tokens",
) -> DataFrame:
    """Token sums before and after with the change in percent."""
    sums = sizes.groupBy(*keys).agg(
        F.sum(tokens_in).alias("input_tokens"), F.sum(tokens_out).alias("output_tokens")
    )
    return sums.withColumn(
        "delta_pct", delta_percent(F.col("input_tokens"), F.col("output_tokens"))
    )


def _counters() -> list[Column]:
    applied = F.col("transformed")
    saved = F.when(applied, F.col("input_tokens") - F.col("output_tokens")).otherwise(0)
    return [
        F.count("*").alias("attempted"),
        F.count_if(applied).alias("applied"),
        F.count_if(~applied).alias("pass_through"),
        F.sum(saved).alias("tokens_saved"),
    ]


def metrics_totals(results: DataFrame) -> DataFrame:
    """Attempted, applied, passed through, and tokens saved by applied rewrites."""
    return results.agg(*_counters())


def metrics_by_tool(results: DataFrame) -> DataFrame:
    """The same counters per tool."""
    return results.groupBy(tool_label(F.col("tool")).alias("tool")).agg(*_counters())


def metrics_daily(results: DataFrame, ts_col: str = "ts") -> DataFrame:
    """The same counters per UTC day."""
    return results.groupBy(F.to_date(ts_col).alias("day")).agg(*_counters())


def metrics_cube(results: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Totals, by tool and by day in one pass; ``scope`` tells them apart."""
    rows = results.select(
        tool_label(F.col("tool")).alias("tool"),
        F.to_date(ts_col).alias("day"),
        "transformed",
        "input_tokens",
        "output_tokens",
    )
    sets = rows.groupingSets([[], ["tool"], ["day"]], "tool", "day").agg(
        F.grouping_id().alias("_set"), *_counters()
    )
    scope = F.when(F.col("_set") == 3, "total").when(F.col("_set") == 1, "tool").otherwise("day")
    return sets.select(
        scope.alias("scope"),
        "tool",
        "day",
        *[c for c in ("attempted", "applied", "pass_through", "tokens_saved")],
    )


def pass_through_reasons(results: DataFrame) -> DataFrame:
    """Number of untransformed results per reason."""
    return (
        results.filter(~F.col("transformed")).groupBy("reason").agg(F.count("*").alias("n"))
    )


def apply_ratio(blocks: DataFrame) -> DataFrame:
    """Counter blocks with the share applied, and that in whole percent."""
    ratio = F.coalesce(F.try_divide(F.col("applied"), F.col("attempted")), F.lit(0.0))
    bounded = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))
    return blocks.withColumn("ratio", bounded).withColumn(
        "percent", F.bround(F.col("ratio") * 100).cast("int")
    )


def regression_check(
    current: DataFrame,
    baseline: DataFrame,
    tolerance: float = TOLERANCE_PERCENT,
    name_col: str = "name",
) -> DataFrame:
    """Each current fixture with its baseline figure and a verdict.

    A percentage above baseline plus tolerance is a regression, a name
    without baseline is reported as missing. Join strategy is left to the
    optimiser, which sees the size of the baseline.
    """
    base = baseline.select(name_col, F.col("delta_pct").alias("baseline_pct"), F.lit(1).alias("_in"))
    joined = current.join(base, name_col, "left")
    verdict = (
        F.when(F.col("_in").isNull(), F.lit("missing baseline fixture"))
        .when(
            F.col("delta_pct") > F.coalesce("baseline_pct", F.lit(0.0)) + tolerance,
            F.lit("regression"),
        )
        .otherwise(F.lit("ok"))
    )
    return joined.select(
        name_col, F.col("delta_pct").alias("current_pct"), "baseline_pct", verdict.alias("verdict")
    )


def changed_lines(
    results: DataFrame, id_col: str = "doc_id", before: str = "text", after: str = "output"
) -> DataFrame:
    """Lines removed (``-``) and added (``+``) per document, as multisets.

    Counted with one grouping of both sides, so each text is read once; rows that share an
    id are documents of their own. ``line_changes`` gives lines in order.
    """
    lines = lambda column, weight: F.transform(
        split_lines(F.col(column)),
        lambda line: F.struct(line.alias("line"), F.lit(weight).alias("w")),
    )
    changed = results.filter(F.col(before) != F.col(after))
    numbered = changed.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select(id_col, "_row", F.inline(F.concat(lines(before, 1), lines(after, -1))))
    sums = rows.groupBy("_row", id_col, "line").agg(F.sum("w").alias("_w")).filter(F.col("_w") != 0)
    return sums.select(
        id_col,
        F.when(F.col("_w") > 0, F.lit("-")).otherwise(F.lit("+")).alias("sign"),
        "line",
        F.abs("_w").alias("n"),
    )


def line_changes(
    results: DataFrame, id_col: str = "doc_id", before: str = "text", after: str = "output", keep: bool = True
) -> DataFrame:
    """Lines of both texts in the order of a diff: id, ``place``, ``sign``, two line numbers, ``line``.

    ``sign`` is a blank for a line that stays, ``-`` for one removed (``after_no`` is NULL) and ``+`` for
    one added (``before_no`` is NULL); between two kept lines the removed come first. Line
    numbers and places start at 1. Each row of ``results`` is compared by itself, so rows may
    share an id; a null text has no lines. Without ``keep`` the kept lines are left out.
    """
    changed = results.select(
        id_col,
        F.coalesce(split_lines(F.col(before)), F.array().cast("array<string>")).alias("_a"),
        F.coalesce(split_lines(F.col(after)), F.array().cast("array<string>")).alias("_b"),
    )
    stays = changed.withColumn("_kept", kept_pairs(F.col("_a"), F.col("_b")))
    number = F.lit(None).cast("int")

    def entry(rank: int, sign: str, i: Column, j: Column, gap: Column, line: Column) -> Column:
        # Sorted by the kept line before, then kept, removed, added, then by number.
        return F.struct(
            gap.alias("gap"), F.lit(rank).alias("rank"), F.coalesce(i, j).alias("no"), F.lit(sign).alias("sign"),
            i.alias("before_no"), j.alias("after_no"), line.alias("line"),
        )

    def missing(lines: str, side: str, rank: int, sign: str) -> Column:
        """Lines of one side that do not stay, with the number of kept lines before them."""
        edges = F.concat(
            F.array(F.lit(-1)), F.transform("_kept", lambda p: p[side]), F.array(F.size(lines))
        )

        def gap(k: Column) -> Column:
            low, high = F.get(edges, k) + 1, F.get(edges, k + 1)
            numbers = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
            place = lambda n: (n + 1, number) if side == "before" else (number, n + 1)
            return F.transform(numbers, lambda n: entry(rank, sign, *place(n), k, F.get(lines, n)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size("_kept")), gap))

    kept = F.transform(
        "_kept", lambda p, k: entry(0, " ", p["before"] + 1, p["after"] + 1, k + 1, F.get("_a", p["before"]))
    )
    parts = [missing("_a", "before", 1, "-"), missing("_b", "after", 2, "+"), *([kept] if keep else [])]
    listed = stays.select(id_col, F.posexplode(F.sort_array(F.concat(*parts))).alias("_p", "_e"))
    return listed.select(
        id_col, (F.col("_p") + 1).alias("place"), "_e.sign", "_e.before_no", "_e.after_no", "_e.line"
    )


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only; empty means the sets are equal."""
    only_left = left.distinct().subtract(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(
        right.distinct().subtract(left).withColumn("side", F.lit("right"))
    )


def same_members(values: Column, required: Column | Sequence[str]) -> Column:
    """True if two arrays hold the same members, in any order and number; per row."""
    needed = required if isinstance(required, Column) else F.array(*[F.lit(v) for v in required])
    return (F.size(F.array_except(values, needed)) == 0) & (
        F.size(F.array_except(needed, values)) == 0
    )


def rule_gate(segments: DataFrame, rules: DataFrame, threshold: float | None = None) -> DataFrame:
    """Segments with their rule and, given a threshold, whether the score passes.

    ``rules`` is ``(kind, enabled)``, at most one row per segment type; a type
    without a row is enabled. The rules become an expression, so segments, most
    of which are of one type, are not shuffled.
    """
    found = rules.select("kind", "enabled").limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES or len({row.kind for row in found}) < len(found):
        raise ValueError(f"rules must have one row per segment type, {MAX_RULES} at most")
    off = [row.kind for row in found if row.enabled is False]
    out = segments.withColumn(
        "enabled", ~F.coalesce(F.col("kind").isin(*off), F.lit(False)) if off else F.lit(True)
    )
    if threshold is not None:
        out = out.withColumn("open", F.col("enabled") & (F.col("score") >= threshold))
    return out


def with_ratio(sizes: DataFrame) -> DataFrame:
    """Token sizes with the relative change of each row."""
    return sizes.withColumn(
        "ratio", compression_ratio(F.col("input_tokens"), F.col("output_tokens"))
    )
