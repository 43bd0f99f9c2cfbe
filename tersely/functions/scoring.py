"""How much a segment is expected to gain from a rewrite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions.logs import repeated_line_count
from tersely.functions.traces import frame_count

# --- fixed values -----------------------------------------------------------
YAML_SCORE = 0.6
PLAIN_SCORE = 0.05
OTHER_SCORE = 0.2
JSON_BASE, JSON_STEP, JSON_MAX = 0.5, 0.03, 0.95
LOG_BASE, LOG_STEP, LOG_MAX = 0.3, 0.05, 0.9
TRACE_SHORT, TRACE_LONG, TRACE_FRAMES = 0.4, 0.75, 6
SCORE_CONFIDENCE = {"json": 0.85, "yaml": 0.75, "log": 0.8, "stacktrace": 0.8, "plain": 0.9}
OTHER_CONFIDENCE = 0.6
# ----------------------------------------------------------------------------


def compaction_score(text: Column, kind: Column) -> Column:
    """Score between 0 and 1 for a segment of type ``kind``."""
    return kind_score(text, F.lower(kind))


def kind_score(text: Column, kind: Column) -> Column:
    """The score for a kind in lower case, as segments have it."""
    objects = (F.length(text) - F.length(F.replace(text, F.lit('{"'), F.lit("")))) / 2
    json_score = JSON_BASE + F.greatest(F.lit(0.0), objects - 1) * JSON_STEP
    log_score = LOG_BASE + repeated_line_count(text) * LOG_STEP
    return (
        F.when(kind == "json", F.least(F.lit(JSON_MAX), json_score))
        .when(kind == "yaml", F.lit(YAML_SCORE))
        .when(kind == "log", F.least(F.lit(LOG_MAX), log_score))
        .when(
            kind == "stacktrace",
            F.when(frame_count(text) < TRACE_FRAMES, F.lit(TRACE_SHORT)).otherwise(
                F.lit(TRACE_LONG)
            ),
        )
        .when(kind == "plain", F.lit(PLAIN_SCORE))
        .otherwise(F.lit(OTHER_SCORE))
    )


def score_confidence(kind: Column) -> Column:
    """Confidence that goes with the score."""
    kind = F.lower(kind)
    known = F.create_map(*[F.lit(x) for pair in SCORE_CONFIDENCE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit(OTHER_CONFIDENCE))


def score_label(kind: Column) -> Column:
    """Type name of the score: plain is ``prose``, no type is ``mixed``."""
    kind = F.lower(kind)
    return F.when(kind == "plain", F.lit("prose")).when(kind == "", F.lit("mixed")).otherwise(kind)
