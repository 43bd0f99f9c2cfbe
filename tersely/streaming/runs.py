"""Collapse runs of equal log lines on an unbounded log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tersely.functions.logs import MIN_RUN, normalise_line, run_marker
from tersely.functions.text import strip

OUTPUT = "stream string, place long, n long, line string"
STATE = "norm string, n long, first_place long, first_line string, last_place long, last_line string"

# Event time without a line after which an open run is given out.
IDLE_MS = 60_000


def _lines_of(run: tuple) -> list[tuple]:
    """Output rows of a closed run: one marker, or its one or two lines."""
    norm, n, first_place, first_line, last_place, last_line = run
    if n >= MIN_RUN:
        return [(first_place, n, f"[×{n}] {norm}")]
    if n == 2:
        return [(first_place, n, first_line), (last_place, n, last_line)]
    return [(first_place, n, first_line)]


def _frame(stream: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["place", "n", "line"])
    out.insert(0, "stream", stream)
    return out


def _runs_of_batch(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of one ordered batch."""
    run = (rows["norm"] != rows["norm"].shift()).cumsum()
    return rows.groupby(run, sort=True).agg(
        norm=("norm", "first"),
        n=("norm", "size"),
        first_place=("place", "first"),
        first_line=("line", "first"),
        last_place=("place", "last"),
        last_line=("line", "last"),
    )


def _merge(held: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """The run left open by ordered rows, and the output of the runs they close."""
    closed: list[tuple] = []
    for run in _runs_of_batch(rows).itertuples(index=False, name=None):
        run = (run[0], int(run[1]), int(run[2]), run[3], int(run[4]), run[5])
        if held is not None and held[0] == run[0]:
            held = (held[0], held[1] + run[1], held[2], held[3], run[4], run[5])
            continue
        if held is not None:
            closed.extend(_lines_of(held))
        held = run
    return held, closed


def _advance(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        run = state.get
        state.remove()
        yield _frame(key[0], _lines_of(run))
        return
    # The rows of one key in one trigger, which the source's rate limit bounds.
    rows = pd.concat(batches).sort_values("place")
    held, closed = _merge(state.get if state.exists else None, rows)
    state.update(held)
    if "seen" in rows:
        idle_from = rows["seen"].max().value // 1_000_000 + IDLE_MS
        state.setTimeoutTimestamp(max(idle_from, state.getCurrentWatermarkMs() + 1))
    yield _frame(key[0], closed)


def collapse_stream(
    lines: DataFrame,
    stream_col: str,
    place_col: str,
    line_col: str = "line",
    ts_col: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Collapsed lines of a streaming table of log lines.

    State per stream is its open run. A run is given out when the line differs
    and, given an event time column, when the watermark has passed its last
    line by ``IDLE_MS``. Lines must arrive in order of ``place_col`` from
    trigger to trigger; within one they may be mixed. ``open_runs`` gives what a
    stream that has ended still holds.
    """
    filled = lines.filter(strip(F.col(line_col)) != "")
    columns = [
        F.col(stream_col).cast("string").alias("stream"),
        F.col(place_col).cast("long").alias("place"),
        F.col(line_col).alias("line"),
        normalise_line(F.col(line_col)).alias("norm"),
    ]
    if ts_col is None:
        rows, timeout = filled.select(*columns), GroupStateTimeout.NoTimeout
    else:
        rows = filled.select(*columns, F.col(ts_col).alias("seen")).withWatermark("seen", delay)
        timeout = GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("stream").applyInPandasWithState(
        _advance, OUTPUT, STATE, "append", timeout
    )


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Output rows of the runs still open where a collapsed stream has stopped.

    Read from the state under its checkpoint folder, so the stream's own output
    and these rows are together the whole collapsed log.
    """
    state = spark.read.format("statestore").load(checkpoint)
    runs = state.select("key.stream", "value.groupState.*")
    row = lambda place, line: F.struct(
        F.col(place).alias("place"), F.col("n"), line.alias("line")
    )
    first, last = row("first_place", F.col("first_line")), row("last_place", F.col("last_line"))
    marker = row("first_place", run_marker(F.col("n"), F.col("norm")))
    lines = (
        F.when(F.col("n") >= MIN_RUN, F.array(marker))
        .when(F.col("n") == 2, F.array(first, last))
        .otherwise(F.array(first))
    )
    return runs.select("stream", F.inline(lines))
