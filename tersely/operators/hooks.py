"""User hooks: token estimators, compressors and segment transformers.

Hooks work on Columns. A Python function is wrapped as an Arrow-batched
Pandas UDF over the array of a document's segments, so it needs no shuffle. The ``batch_``
forms hand all segments of an Arrow batch to the function in one call, for models and
services that are dear to call; the ``python_`` forms call it for each segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tersely.functions import logs, traces, yaml_text
from tersely.functions.text import estimate_tokens


@dataclass(frozen=True)
class Estimator:
    """Token estimator for one text and for an array of texts."""

    name: str
    one: Callable[[Column], Column]
    many: Callable[[Column], Column]


@dataclass(frozen=True)
class Compressor:
    """``compress(segments)``: array of candidate texts, NULL where not applicable.

    ``segments`` is an array of structs with ``kind`` and ``text``; segments
    that may not be rewritten arrive as NULL. ``name_of`` gives the name a
    rewrite of a kind is reported under.
    """

    name_of: Callable[[Column], Column]
    compress: Callable[[Column], Column]


HEURISTIC = Estimator(
    "heuristic-char4",
    estimate_tokens,
    lambda texts: F.transform(texts, estimate_tokens),
)


def python_estimator(name: str, estimate: Callable[[str], int]) -> Estimator:
    """Estimator from a Python function of one text."""

    @F.pandas_udf("long")
    def one(texts: pd.Series) -> pd.Series:
        return texts.map(estimate, na_action="ignore")

    @F.pandas_udf("array<long>")
    def many(arrays: pd.Series) -> pd.Series:
        return arrays.map(
            lambda texts: [None if t is None else estimate(t) for t in texts], na_action="ignore"
        )

    return Estimator(name, one, many)


def batch_estimator(name: str, estimate: Callable[[list[str]], Sequence[int]]) -> Estimator:
    """Estimator from a Python function of many texts, called once for each Arrow batch.

    It gives one number for each text. Null texts are not handed over and stay null.
    """

    @F.pandas_udf("long")
    def one(texts: pd.Series) -> pd.Series:
        return _for_each([[t] for t in texts], estimate).map(lambda found: found[0])

    @F.pandas_udf("array<long>")
    def many(arrays: pd.Series) -> pd.Series:
        return _for_each(arrays, estimate)

    return Estimator(name, one, many)


def _for_each(arrays: Iterable, call: Callable[[list], Sequence]) -> pd.Series:
    """``arrays`` with each item that is not null replaced by its result; one call for all of them."""
    lists = [None if items is None else list(items) for items in arrays]
    given = [item for items in lists if items is not None for item in items if item is not None]
    found = list(call(given)) if given else []
    if len(found) != len(given):
        raise ValueError(f"the hook gave {len(found)} results for {len(given)} items")
    results = iter(found)
    fill = lambda items: [None if item is None else next(results) for item in items]
    return pd.Series([None if items is None else fill(items) for items in lists], dtype=object)


def column_compressor(
    name: str,
    can_handle: Callable[[Column, Column], Column],
    compress: Callable[[Column], Column],
) -> Compressor:
    """Compressor from Column functions ``can_handle(text, kind)`` and ``compress(text)``."""
    return Compressor(
        lambda kind: F.lit(name),
        lambda segments: F.transform(
            segments,
            lambda s: F.when(
                s.isNotNull() & can_handle(s["text"], s["kind"]), compress(s["text"])
            ),
        ),
    )


def python_compressor(
    name: str,
    can_handle: Callable[[str, str], bool],
    compress: Callable[[str], tuple[str, bool]],
) -> Compressor:
    """Compressor from Python functions; one that raises counts as not applicable."""

    def candidate(segment) -> str | None:
        if segment is None:
            return None
        try:
            if not can_handle(segment["text"], segment["kind"]):
                return None
            text, changed = compress(segment["text"])
        except Exception:
            return None
        return text if changed else None

    @F.pandas_udf("array<string>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda found: [candidate(s) for s in found], na_action="ignore")

    return Compressor(lambda kind: F.lit(name), run)


def batch_compressor(
    name: str, compress: Callable[[list[str], list[str]], Sequence[str | None]]
) -> Compressor:
    """Compressor from a Python function of many texts and their kinds, called once for each Arrow batch.

    It gives a new text for each, or None where it does not apply; nothing is caught.
    """

    @F.pandas_udf("array<string>")
    def run(arrays: pd.Series) -> pd.Series:
        both = lambda segments: compress([s["text"] for s in segments], [s["kind"] for s in segments])
        return _for_each(arrays, both)

    return Compressor(lambda kind: F.lit(name), run)


def _builtin(segment: Column) -> Column:
    text, kind = segment["text"], segment["kind"]
    return (
        F.when(kind == "yaml", yaml_text.record_block(text))
        .when(kind == "log", logs.collapse_runs(text))
        .when(kind == "stacktrace", traces.elide_frames(text))
    )


# The three built-in compressors handle one kind each, so one pass covers them.
BUILTIN = Compressor(
    lambda kind: F.concat(F.lit("builtin."), kind),
    lambda segments: F.transform(segments, _builtin),
)
