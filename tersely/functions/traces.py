"""Stack traces inside one document."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions import compact_form as form
from tersely.functions.text import WHITE_SPACE, filled_lines, let, rstrip, split_lines

# --- fixed values -----------------------------------------------------------
FRAME_STARTS = ('File "', "at ", "frame #")
FRAME_PART = ".go:"
TRACE_WORD = "Traceback"
AFTER_AT = r"(?U)\bat [^\n]*+"
PLACE = r"(?U):\d"
SCORED_STARTS = ("File ", "at ")
HEAD = 3
TAIL = 3
MIN_LINES = 8
MIN_FRAMES = 6
# ----------------------------------------------------------------------------


def _begins(line: Column, starts: tuple[str, ...]) -> Column:
    """True if a line begins with one of some words, white space aside. No regular expression."""
    return let(
        F.ltrim(line, F.lit(WHITE_SPACE)),
        lambda bare: reduce(or_, (F.startswith(bare, F.lit(word)) for word in starts)),
    )


def is_frame(line: Column) -> Column:
    """True for a line that shows one stack frame."""
    return _begins(line, FRAME_STARTS) | F.contains(line, F.lit(FRAME_PART))


def frame_count(text: Column) -> Column:
    """Frames as the score counts them."""
    return F.size(F.filter(split_lines(text), lambda line: _begins(line, SCORED_STARTS)))


def is_trace(text: Column) -> Column:
    """Names a traceback or an ``at place:line``, over two or more lines."""
    # Plain substring tests come first: most texts fail them without a regex. What
    # follows a line's first "at " is looked at once, so long lines cost no more.
    placed = F.exists(
        F.regexp_extract_all(text, F.lit(AFTER_AT), F.lit(0)), lambda rest: rest.rlike(PLACE)
    )
    named = F.contains(text, F.lit(TRACE_WORD)) | (
        F.contains(text, F.lit("at ")) & F.contains(text, F.lit(":")) & placed
    )
    return F.when(named, F.size(filled_lines(text)) >= 2).otherwise(F.lit(False))


def elided_marker(count: Column) -> Column:
    """The line that stands for dropped frames."""
    return F.concat(F.lit("[... "), count.cast("string"), F.lit(" frames omitted ...]"))


def elide_frames(text: Column) -> Column:
    """Text with the middle frames dropped, NULL when not applicable or unchanged.

    The first and last three frames and every other line stay. Dropped frames
    lie strictly between two frame positions, so each kept line only needs its
    predecessor among the kept lines to know how many were dropped before it.
    """

    def with_lines(lines: Column) -> Column:
        return F.when(
            F.size(lines) >= MIN_LINES,
            let(F.transform(lines, is_frame), lambda flags: with_flags(lines, flags)),
        )

    def with_flags(lines: Column, flags: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(flags, i))
        return let(found, lambda f: with_frames(lines, flags, f))

    def with_frames(lines: Column, flags: Column, found: Column) -> Column:
        last_head = F.get(found, F.lit(HEAD - 1))
        first_tail = F.get(found, F.size(found) - TAIL)
        kept = F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1),
            lambda i: (i <= last_head) | (i >= first_tail) | ~F.get(flags, i),
        )
        short = let(kept, lambda k: with_kept(lines, k))
        return F.when(
            F.size(found) >= MIN_FRAMES,
            let(short, lambda out: F.when(out != text, out)),
        )

    def with_kept(lines: Column, kept: Column) -> Column:
        def emit(index: Column, k: Column) -> Column:
            gap = index - F.coalesce(F.get(kept, k - 1), F.lit(-1)) - 1
            line = F.get(lines, index)
            return F.when(gap > 0, F.array(elided_marker(gap), line)).otherwise(F.array(line))

        return form.block(F.flatten(F.transform(kept, emit)))

    return let(filled_lines(text), with_lines)


def list_block(text: Column) -> Column:
    """The trace as a compact list of its lines."""

    def render(lines: Column) -> Column:
        head = F.array(
            F.lit("trace:"), F.concat(form.indent(1), form.list_header("stack", F.size(lines)))
        )
        items = F.transform(lines, lambda line: F.concat(F.lit("    - "), rstrip(line)))
        return form.block(F.concat(head, items))

    return let(filled_lines(text), render)
