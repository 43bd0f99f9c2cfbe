"""Log text inside one document: fields, runs, repeats, record form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions import compact_form as form
from tersely.functions.text import LINE_END, filled_lines, let, strip

# --- fixed values -----------------------------------------------------------
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG", "TRACE")
MIN_RUN = 3
TIMESTAMP = (
    r"(?U)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\s*"
    r"|^\[\d+\]\s*"
    r"|^\d{2}/\w+/\d{4}[: ]"
)
# ----------------------------------------------------------------------------
LEVEL_WORD = rf"(?U)\b(?:{'|'.join(LEVELS)})\b"
FIELDS = rf"(?Us)^(?:(\S+)\s+)?({'|'.join(LEVELS)})\s+(.*)"
FIELD_KEYS = ("ts", "level", "msg")


def normalise_line(line: Column) -> Column:
    """The line without its leading timestamp and outer white space."""
    return strip(F.regexp_replace(line, TIMESTAMP, ""))


def has_level(line: Column) -> Column:
    """True if the line names a log level."""
    return line.rlike(LEVEL_WORD)


def line_fields(line: Column) -> Column:
    """Struct ``(ts, level, msg, line)``; an unmatched line fills only ``line``."""
    hit = line.rlike(FIELDS)
    part = lambda group: F.when(hit, F.regexp_extract(line, FIELDS, group))
    return F.struct(
        F.nullif(part(1), F.lit("")).alias("ts"),
        part(2).alias("level"),
        part(3).alias("msg"),
        F.when(~hit, line).alias("line"),
    )


def is_log(text: Column) -> Column:
    """Two or more lines, two or more of them with a level."""
    named = F.lit(False)
    for level in LEVELS:
        named = named | F.contains(text, F.lit(level))
    return F.when(named, F.size(F.filter(filled_lines(text), has_level)) >= 2).otherwise(
        F.lit(False)
    )


def run_marker(count: Column, normal: Column) -> Column:
    """The one line that stands for a whole run."""
    return F.concat(F.lit("[×"), count.cast("string"), F.lit("] "), normal)


def collapse_runs(text: Column) -> Column:
    """Collapsed text of one document, NULL when no run is long enough."""

    def with_lines(lines: Column) -> Column:
        return F.when(
            F.size(lines) >= MIN_RUN,
            let(F.transform(lines, normalise_line), lambda normal: with_normal(lines, normal)),
        )

    def with_normal(lines: Column, normal: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(normal) - 1),
            lambda i: (i == 0) | (F.get(normal, i) != F.get(normal, i - 1)),
        )
        return let(starts, lambda s: with_starts(lines, normal, s))

    def with_starts(lines: Column, normal: Column, starts: Column) -> Column:
        runs = F.transform(
            starts,
            lambda first, k: F.struct(
                first.alias("first"),
                (F.coalesce(F.get(starts, k + 1), F.size(lines)) - first).alias("n"),
            ),
        )
        return let(
            runs,
            lambda r: F.when(
                F.exists(r, lambda run: run["n"] >= MIN_RUN),
                form.block(F.flatten(F.transform(r, lambda run: render(run, lines, normal)))),
            ),
        )

    def render(run: Column, lines: Column, normal: Column) -> Column:
        return F.when(
            run["n"] >= MIN_RUN, F.array(run_marker(run["n"], F.get(normal, run["first"])))
        ).otherwise(F.slice(lines, run["first"] + 1, run["n"]))

    return let(filled_lines(text), with_lines)


def repeated_line_count(text: Column) -> Column:
    """Number of distinct lines, digits masked, that occur three times or more."""
    masked = F.filter(
        F.transform(
            F.split(text, LINE_END, -1), mask_digits
        ),
        lambda line: line != "",
    )
    # In sorted order a line seen three times equals its second successor.
    return let(
        F.array_sort(masked),
        lambda s: F.when(F.size(s) < 3, F.lit(0)).otherwise(
            F.size(
                F.filter(
                    F.sequence(F.lit(0), F.size(s) - 3),
                    lambda i: (F.get(s, i) == F.get(s, i + 2))
                    & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))),
                )
            )
        ),
    )


def mask_digits(line: Column) -> Column:
    """Trimmed line with every digit set to 0."""
    return F.regexp_replace(strip(line), r"(?U)\d", "0")


def record_block(text: Column) -> Column:
    """Parsed log lines as a compact block."""
    keys = F.array(*[F.lit(key) for key in FIELD_KEYS])

    def render(fields: Column) -> Column:
        all_hit = F.forall(fields, lambda f: f["level"].isNotNull())
        none_hit = F.forall(fields, lambda f: f["level"].isNull())
        count = F.size(fields)
        rows = lambda cells: F.transform(
            fields, lambda f: F.concat(form.indent(1), form.row(cells(f)))
        )
        entries = lambda f: F.when(
            f["level"].isNull(),
            F.array(F.lit("  -"), F.concat(F.lit("    line: "), f["line"])),
        ).otherwise(
            F.concat(
                F.array(F.lit("  -")),
                F.array(
                    *[
                        F.concat(form.indent(2), F.lit(f"{key}: "), form.scalar(f[key]))
                        for key in FIELD_KEYS
                    ]
                ),
            )
        )
        return (
            F.when(
                all_hit,
                form.block(
                    F.concat(
                        F.array(form.table_header(form.ROOT_NAME, count, keys)),
                        rows(lambda f: F.array(*[form.cell(f[key]) for key in FIELD_KEYS])),
                    )
                ),
            )
            .when(
                none_hit,
                form.block(
                    F.concat(
                        F.array(
                            form.table_header(form.ROOT_NAME, count, F.array(F.lit("line")))
                        ),
                        rows(lambda f: F.array(form.cell(f["line"]))),
                    )
                ),
            )
            .otherwise(
                form.block(
                    F.concat(
                        F.array(form.list_header(form.ROOT_NAME, count)),
                        F.flatten(F.transform(fields, entries)),
                    )
                )
            )
        )

    return let(F.transform(filled_lines(text), line_fields), render)
