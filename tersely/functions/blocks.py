"""Which kind of structured text a block is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions.delimited import parse_rows
from tersely.functions.json_text import is_json
from tersely.functions.logs import is_log
from tersely.functions.text import let, split_lines, strip
from tersely.functions.traces import TRACE_WORD, is_trace
from tersely.functions.yaml_text import is_yaml

# --- fixed values -----------------------------------------------------------
KINDS = ("plain", "json", "yaml", "log", "stacktrace", "tree", "table", "unknown")
CONFIDENCE = {
    "json": 0.99,
    "stacktrace": 0.75,
    "tree": 0.7,
    "table": 0.7,
    "log": 0.8,
    "yaml": 0.9,
}
REASON = {
    "json": "parsed as JSON",
    "stacktrace": "detected stack trace",
    "tree": "detected tree-like structured text",
    "table": "parsed as tabular data",
    "log": "parsed as log lines",
    "yaml": "parsed as YAML",
    "plain": "left as plain text",
}
TREE_PATTERN = r"(?U)\b\w+\[\d+\]:"
# ----------------------------------------------------------------------------


def lookup(kind: Column, values: dict[str, object], default: object = None) -> Column:
    """Value for a kind from a small fixed table."""
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(kind == key, F.lit(value)).otherwise(out)
    return out


def is_tree(text: Column) -> Column:
    """Names ``word[n]:`` and has two or more lines with a colon."""
    colons = F.filter(split_lines(text), lambda line: F.contains(line, F.lit(":")))
    named = F.contains(text, F.lit("]:")) & text.rlike(TREE_PATTERN)
    return F.when(named, F.size(colons) >= 2).otherwise(F.lit(False))


def is_yaml_block(text: Column) -> Column:
    """YAML subset, but neither a traceback nor a tree."""
    hinted = (
        F.contains(text, F.lit(":"))
        | F.contains(text, F.lit("- "))
        | F.contains(text, F.lit("\n"))
    )
    other = F.contains(text, F.lit(TRACE_WORD)) | (
        F.contains(text, F.lit("]:")) & text.rlike(TREE_PATTERN)
    )
    return F.when(hinted & ~other, is_yaml(text)).otherwise(F.lit(False))


def block_kind(text: Column, only: Column | None = None) -> Column:
    """First kind that accepts a block, ``plain`` if none does.

    ``only`` names the single kind to try; the empty string means all.
    """
    only = F.lit("") if only is None else only
    every = only == ""
    return (
        F.when(only.isin("", "json") & is_json(text), F.lit("json"))
        .when(every & is_trace(text), F.lit("stacktrace"))
        .when(every & is_tree(text), F.lit("tree"))
        .when(every & parse_rows(text).isNotNull(), F.lit("table"))
        .when(only.isin("", "log") & is_log(text), F.lit("log"))
        .when(only.isin("", "yaml") & is_yaml_block(text), F.lit("yaml"))
        .otherwise(F.lit("plain"))
    )


def classify(text: Column) -> Column:
    """Kind of a whole text, ignoring outer white space."""
    return let(strip(text), lambda trimmed: block_kind(trimmed))
