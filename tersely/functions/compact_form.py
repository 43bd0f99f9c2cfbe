"""Pieces of the compact block format: scalars, cells, headers, rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the block format, version 1 ------------------------------
FORMAT_VERSIONS = ("1",)
INDENT = "  "
ROOT_NAME = "data"
# ----------------------------------------------------------------------------


def indent(depth: Column | int) -> Column:
    """Two spaces per level."""
    if isinstance(depth, int):
        return F.lit(INDENT * depth)
    return F.repeat(F.lit(INDENT), depth)


def scalar(value: Column) -> Column:
    """Text of a scalar; a missing value is ``null``."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def escape_cell(text: Column) -> Column:
    """Escape backslash, comma and newline, in this order."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(","), F.lit("\\,"))
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def cell(value: Column) -> Column:
    """One cell of a record row."""
    return escape_cell(scalar(value))


def table_header(name: Column | str, count: Column, keys: Column) -> Column:
    """``name[count]{k1,k2}:``"""
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(
        name, F.lit("["), count.cast("string"), F.lit("]{"), F.array_join(keys, ","), F.lit("}:")
    )


def list_header(name: Column | str, count: Column) -> Column:
    """``name[count]:``"""
    name = F.lit(name) if isinstance(name, str) else name
    return F.concat(name, F.lit("["), count.cast("string"), F.lit("]:"))


def row(cells: Column) -> Column:
    """One record row from its escaped cells."""
    return F.array_join(cells, ",")


def block(lines: Column) -> Column:
    """Join finished lines and close the block with a newline."""
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))
