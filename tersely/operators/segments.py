"""Documents to segments: fences, prose pieces, tail; line ranges."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions.blocks import (
    CONFIDENCE,
    REASON,
    block_kind,
    lookup,
)
from tersely.functions.text import let, newlines, strip

# --- fixed values -----------------------------------------------------------
FENCE = r"(?s)```([a-zA-Z0-9_-]*)\n(.*?)```"
KIND_OF_LABEL = {"json": "json", "yaml": "yaml", "yml": "yaml", "log": "log", "logs": "log"}
# ----------------------------------------------------------------------------

SEGMENT = (
    "struct<kind:string,source:string,text:string,confidence:double,reason:string,"
    "lead:string,trail:string>"
)


def _piece(role: str, raw: Column, label: Column | None, lead: Column) -> Column:
    return F.struct(
        F.lit(role).alias("role"),
        raw.alias("raw"),
        (F.lit(None).cast("string") if label is None else label).alias("label"),
        lead.alias("lead"),
    )


def _pieces(text: Column) -> Column:
    """Prose pieces and fences of a text in order, then the tail.

    ``lead`` holds the fence marks between a piece and the one before it.
    """
    close = F.lit("```")

    def with_parts(parts: Column) -> Column:
        count = F.size(parts["bodies"])

        def around(i: Column) -> Column:
            prose = F.get(parts["prose"], i)
            label = F.get(parts["labels"], i)
            closed = F.when(i > 0, close).otherwise(F.lit(""))
            opened = F.concat(close, label, F.lit("\n"))
            fence = lambda lead: _piece(
                "fence", F.get(parts["bodies"], i), F.lower(label), lead
            )
            return F.when(prose == "", F.array(fence(F.concat(closed, opened)))).otherwise(
                F.array(_piece("prose", prose, None, closed), fence(opened))
            )

        rest = F.get(parts["prose"], count)
        tail = F.filter(F.array(_piece("tail", rest, None, close)), lambda p: p["raw"] != "")
        return F.when(
            count > 0,
            F.concat(F.flatten(F.transform(F.sequence(F.lit(0), count - 1), around)), tail),
        ).otherwise(unfenced)

    parts = F.struct(
        F.split(text, FENCE, -1).alias("prose"),
        F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)).alias("labels"),
        F.regexp_extract_all(text, F.lit(FENCE), F.lit(2)).alias("bodies"),
    )
    # Without a fence the tail is the whole text, already known to be plain.
    unfenced = F.array(_piece("unfenced", text, None, F.lit("")))
    return F.when(F.contains(text, close), let(parts, with_parts)).otherwise(unfenced)


def _segment(piece: Column) -> Column:
    """Segment of a piece.

    Prose and a one-line tail are plain. A fence labelled json, yaml or log is
    that kind or plain and keeps its body as it is; any other block takes the
    first kind that accepts it, and a hit stores the trimmed text. ``lead``
    and ``trail`` are the characters around the stored text.
    """
    role, raw, label = piece["role"], piece["raw"], piece["label"]

    def with_trimmed(trimmed: Column) -> Column:
        only = F.coalesce(lookup(label, KIND_OF_LABEL), F.lit(""))
        one_line = role.isin("tail", "unfenced") & ~F.contains(trimmed, F.lit("\n"))
        asked = (role != "prose") & ~one_line
        block = F.when(only == "", trimmed).otherwise(raw)
        found = F.struct(
            trimmed.alias("trimmed"),
            only.alias("only"),
            asked.alias("asked"),
            F.when(asked & (role != "unfenced"), let(block, lambda b: block_kind(b, only)))
            .otherwise(F.lit("plain"))
            .alias("kind"),
        )
        return let(found, finished)

    def finished(found: Column) -> Column:
        kind, only, asked = found["kind"], found["only"], found["asked"]
        hit = kind != "plain"
        trims = hit & (only == "")
        trimmed = found["trimmed"]
        before = F.when(trims, F.instr(raw, trimmed) - 1).otherwise(F.lit(0))
        source = (
            F.when(~asked, F.lit("plain"))
            .when(role == "whole", F.lit("whole"))
            .when(role.isin("tail", "unfenced"), F.lit("mixed-tail"))
            .otherwise(
                F.concat(
                    F.lit("fenced-"),
                    F.when(only != "", only)
                    .when(label == "", F.lit("plain"))
                    .otherwise(label),
                )
            )
        )
        missed = F.when(asked & (only != ""), F.lit(0.0)).otherwise(F.lit(1.0))
        return let(
            before,
            lambda n: F.struct(
                kind.alias("kind"),
                source.alias("source"),
                F.when(trims, trimmed).otherwise(raw).alias("text"),
                F.when(hit, lookup(kind, CONFIDENCE)).otherwise(missed).alias("confidence"),
                F.when(asked & (hit | (only == "")), lookup(kind, REASON)).alias("reason"),
                F.concat(piece["lead"], F.substring(raw, F.lit(1), n)).alias("lead"),
                F.when(trims, F.substring(raw, n + F.length(trimmed) + 1, F.length(raw)))
                .otherwise(F.lit(""))
                .alias("trail"),
            ),
        )

    return let(strip(raw), with_trimmed)


def block_texts(text: Column) -> Column:
    """All texts that segments of a document may hold but prose: itself, fence bodies, the tail."""
    parts = F.split(text, FENCE, -1)
    bodies = F.regexp_extract_all(text, F.lit(FENCE), F.lit(2))
    fenced = F.concat(bodies, F.transform(bodies, strip), F.array(strip(F.element_at(parts, -1))))
    whole = F.array(strip(text))
    return F.when(F.contains(text, F.lit("```")), F.concat(whole, fenced)).otherwise(whole)


def segment_array(text: Column) -> Column:
    """Segments of a text as an array; empty for an empty text.

    The whole text is tried first. If it is structured it is the only segment
    and its fences are not looked at, else it makes way for its pieces.
    """
    whole = _piece("whole", text, None, F.lit(""))

    def add(found: Column, piece: Column) -> Column:
        settled = F.coalesce(F.get(found, F.lit(0))["kind"] != "plain", F.lit(False))
        return F.when(settled, found).otherwise(F.array_append(found, let(piece, _segment)))

    def finish(found: Column) -> Column:
        first = F.get(found, F.lit(0))
        return F.when(first["kind"] != "plain", F.slice(found, F.lit(1), F.lit(1))).otherwise(
            F.slice(found, F.lit(2), F.size(found))
        )

    return F.when(text == "", F.array().cast(f"array<{SEGMENT}>")).otherwise(
        F.aggregate(
            F.concat(F.array(whole), _pieces(text)),
            F.array().cast(f"array<{SEGMENT}>"),
            add,
            finish,
        )
    )


@cache
def segments_of(text_col: str) -> Column:
    """``segment_array`` of a named column; the expression is built once."""
    return segment_array(F.col(text_col))


@cache
def line_ranges_of(segments_col: str) -> Column:
    """``line_ranges`` of a named column; the expression is built once."""
    return line_ranges(F.col(segments_col))


def line_ranges(segments: Column) -> Column:
    """1-based first and last line of every segment, found from a moving cursor.

    The text still to be searched never reaches past the segment itself, so
    one pass carries only what an earlier find left unread.
    """
    ranges = "array<struct<line_start:int,line_end:int>>"
    start = F.struct(
        F.lit("").alias("rest"),
        F.lit(1).alias("line"),
        F.array().cast(ranges).alias("out"),
    )

    def step(state: Column, s: Column) -> Column:
        return let(F.concat(state["rest"], s["lead"], s["text"]), lambda r: found(state, s, r))

    def found(state: Column, s: Column, region: Column) -> Column:
        at = F.when(s["text"] == "", F.lit(1)).otherwise(F.instr(region, s["text"]))
        return let(at, lambda p: advance(state, s, region, p))

    def advance(state: Column, s: Column, region: Column, at: Column) -> Column:
        first = state["line"] + newlines(F.substring(region, F.lit(1), at - 1))
        inner = newlines(F.substring(s["text"], F.lit(1), F.length(s["text"]) - 1))
        return F.struct(
            F.concat(
                F.substring(region, at + F.length(s["text"]), F.length(region)), s["trail"]
            ).alias("rest"),
            (first + newlines(s["text"])).alias("line"),
            F.array_append(
                state["out"],
                F.struct(first.alias("line_start"), (first + inner).alias("line_end")),
            ).alias("out"),
        )

    return F.aggregate(segments, start, step, lambda state: state["out"])


def materialise(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns computed once per row.

    Filters on a projected column are pushed below the projection with the
    whole expression copied; they are not pushed below a generator.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def segment_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per segment: ``(id, seg_no, kind, source, text, confidence, reason)``."""
    found = documents.select(id_col, F.posexplode(segments_of(text_col)).alias("p", "s"))
    return found.select(
        id_col,
        (F.col("p") + 1).alias("seg_no"),
        *[f"s.{name}" for name in ("kind", "source", "text", "confidence", "reason")],
    )


def nth_segment(segments: DataFrame, n: int) -> DataFrame:
    """The n-th segment (1-based) of every document that has one."""
    return segments.filter(F.col("seg_no") == n)


def segment_type_counts(
    segments: DataFrame, id_col: str | None = "doc_id"
) -> DataFrame:
    """Segments per upper-case type, per document or over the corpus."""
    keys = [F.upper("kind").alias("type")]
    if id_col is not None:
        keys.insert(0, F.col(id_col))
    return segments.groupBy(*keys).agg(F.count("*").alias("n"))
