"""Ordered differences of two texts by lines, computed row by row.

Lines that occur once on either side are anchors; the longest sequence of anchors in the same
order on both sides is kept, and the gaps between anchors are treated alike. A gap without
anchors keeps its common head and tail; what is left of it is removed and added.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

PAIR = StructType([StructField("before", IntegerType()), StructField("after", IntegerType())])


def _anchors(a: Sequence[str], b: Sequence[str], gap: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Places of lines unique on both sides, the longest sequence that rises on both."""
    low_a, high_a, low_b, high_b = gap
    seen_a, seen_b = Counter(a[low_a:high_a]), Counter(b[low_b:high_b])
    at_b = {line: j for j, line in enumerate(b[low_b:high_b], low_b) if seen_b[line] == 1}
    common = [(i, at_b[a[i]]) for i in range(low_a, high_a) if seen_a[a[i]] == 1 and a[i] in at_b]
    tails: list[int] = []  # smallest end in b of a rising sequence of each length
    ends: list[int] = []  # its number in ``common``
    before: list[int | None] = []
    for n, (_, j) in enumerate(common):
        length = bisect_left(tails, j)
        before.append(ends[length - 1] if length else None)
        tails[length : length + 1] = [j]
        ends[length : length + 1] = [n]
    chain, n = [], ends[-1] if ends else None
    while n is not None:
        chain.append(common[n])
        n = before[n]
    return chain[::-1]


def kept_lines(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places (from 0) of the lines that stay, rising on both sides."""
    kept: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        low_a, high_a, low_b, high_b = gaps.pop()
        while low_a < high_a and low_b < high_b and a[low_a] == b[low_b]:
            kept.append((low_a, low_b))
            low_a, low_b = low_a + 1, low_b + 1
        while low_a < high_a and low_b < high_b and a[high_a - 1] == b[high_b - 1]:
            high_a, high_b = high_a - 1, high_b - 1
            kept.append((high_a, high_b))
        chain = _anchors(a, b, (low_a, high_a, low_b, high_b))
        kept += chain
        if chain:
            starts = [(low_a, low_b), *((i + 1, j + 1) for i, j in chain)]
            gaps += [(i, k, j, m) for (i, j), (k, m) in zip(starts, [*chain, (high_a, high_b)])]
    return sorted(kept)


@F.pandas_udf(ArrayType(PAIR))
def _kept(before: pd.Series, after: pd.Series) -> pd.Series:
    def pairs(a: Sequence[str] | None, b: Sequence[str] | None) -> list[dict] | None:
        if a is None or b is None:
            return None
        return [{"before": i, "after": j} for i, j in kept_lines(list(a), list(b))]

    return pd.Series([pairs(a, b) for a, b in zip(before, after)], dtype=object)


def kept_pairs(before: Column, after: Column) -> Column:
    """Array of ``(before, after)`` places, from 0, of the lines of two arrays that stay."""
    return _kept(before, after)
