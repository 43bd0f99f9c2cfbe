"""The steps of near copies hold little more than a slice of the texts they get."""

from __future__ import annotations

import tracemalloc

import pytest
from test_worker_memory import Rows

from tersely.llm import near_copies

N = 1_500
TEXT = [" ".join(f"word{(k * 7 + j) % 997}" for j in range(300)) for k in range(N)]


@pytest.mark.parametrize(
    "work",
    [
        lambda n: near_copies.features(
            Rows(doc_id=list(range(n)), doc_key=[0] * n, has_id=[True] * n, text=TEXT[:n]), 4
        ),
        lambda n: near_copies.packed_sets(Rows(doc_id=list(range(n)), text=TEXT[:n]), 4),
    ],
)
def test_a_step_holds_a_slice_of_its_batch(work):
    work(2)  # tables of powers are made once
    tracemalloc.start()
    try:
        out = work(N)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in out) == N
    assert peak < 20_000_000
