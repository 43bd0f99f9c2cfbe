"""Streams give what the batch operators give."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tersely.operators.runs import collapse_line_runs
from tersely.sources import snapshots
from tersely.streaming import chunks, runs
from tersely.streaming.metrics import running_metrics


def write_batches(folder, batches):
    folder.mkdir()
    for n, rows in enumerate(batches):
        path = folder / f"{n}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        # Files are read in order of their age.
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run_to_memory(df, name, tmp_path, mode):
    started = (
        df.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination(120)
    assert not started.isActive
    return df.sparkSession.table(name).collect()


SCHEMA = "stream string, place long, line string, ts timestamp"


def log_batches():
    lines = ["a", "a", "b", "b", "b", "b", "c", "a", "a", "a", "x", "y"]
    rows = [
        {"stream": s, "place": n, "line": f"2024-01-01T00:00:{n:02d}Z INFO {m}", "ts": f"2024-01-01T00:00:{n:02d}Z"}
        for s in ("p", "q")
        for n, m in enumerate(lines)
    ]
    # Runs cross the borders between triggers.
    return [[r for r in rows if r["place"] in part] for part in (range(0, 4), range(4, 9), range(9, 12))]


def test_runs_across_triggers(spark, tmp_path):
    batches = log_batches()
    write_batches(tmp_path / "in", batches)
    stream = source(spark, tmp_path / "in", SCHEMA)
    got = run_to_memory(runs.collapse_stream(stream, "stream", "place"), "log_runs", tmp_path, "append")
    batch = spark.createDataFrame(
        [(r["stream"], r["place"], r["line"]) for b in batches for r in b],
        "stream string, place long, line string",
    )
    whole = collapse_line_runs(batch, ["stream"], ["place"]).collect()
    closed = {(r.stream, r.place, r.line) for r in whole if r.place != 11}
    assert {(r.stream, r.place, r.line) for r in got} == closed


def test_open_run_is_given_out_by_event_time(spark, tmp_path):
    late = [{"stream": "z", "place": 1, "line": "INFO end", "ts": "2024-01-01T05:00:00Z"}]
    write_batches(tmp_path / "in", [*log_batches(), late])
    stream = source(spark, tmp_path / "in", SCHEMA)
    timed = runs.collapse_stream(stream, "stream", "place", ts_col="ts", delay="1 minute")
    got = run_to_memory(timed, "timed_runs", tmp_path, "append")
    assert {(r.stream, r.place) for r in got if r.place == 11} == {("p", 11), ("q", 11)}


def test_running_metrics(spark, tmp_path):
    rows = [
        {"ts": f"2024-01-0{d}T10:00:00Z", "tool": t, "transformed": d == 1, "input_tokens": 9, "output_tokens": 4}
        for d in (1, 2)
        for t in ("a", " ", "a")
    ]
    write_batches(tmp_path / "in", [rows[:2], rows[2:]])
    schema = "ts timestamp, tool string, transformed boolean, input_tokens long, output_tokens long"
    stream = running_metrics(source(spark, tmp_path / "in", schema))
    got = {(str(r.day), r.tool): (r.attempted, r.applied, r.tokens_saved) for r in run_to_memory(stream, "running", tmp_path, "complete")}
    assert got == {
        ("2024-01-01", "a"): (2, 2, 10),
        ("2024-01-01", "unknown"): (1, 1, 5),
        ("2024-01-02", "a"): (2, 0, 0),
        ("2024-01-02", "unknown"): (1, 0, 0),
    }


def test_chunked_compaction(spark, tmp_path):
    text = "INFO some event\n" * 40
    write_batches(tmp_path / "in", [[{"doc_id": 1, "text": text}], [{"doc_id": 2, "text": "plain"}]])
    stream = source(spark, tmp_path / "in", "doc_id long, text string")
    out = str(tmp_path / "out")

    def write(df, batch_id):
        df.select("doc_id", "chunk_no", "output").write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    chunks.stream_compact(stream, write, str(tmp_path / "ck"), size=160).awaitTermination(240)
    got = spark.read.parquet(out).orderBy("doc_id", "chunk_no").collect()
    assert [r.output for r in got] == ["[×10] INFO some event\n"] * 4 + ["plain"]


def test_chunks_are_recorded_and_counted_once(spark, tmp_path):
    """Records and counters of two triggers; a repeated batch replaces its records and counts once."""
    text = "INFO some event\n" * 40
    rows = [{"doc_id": n, "text": text if n < 3 else "plain", "who": "ab"[n % 2]} for n in range(4)]
    write_batches(tmp_path / "in", [rows[:2], rows[2:]])
    stream = source(spark, tmp_path / "in", "doc_id long, text string, who string")
    folder = str(tmp_path / "out")
    when = F.lit("2024-02-03").cast("timestamp")
    chunks.record_chunks(stream, folder, F.col("who"), when, size=160).awaitTermination(240)
    found = spark.read.parquet(f"{folder}/chunks").orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk_no) for r in found] == [(n, c) for n in range(3) for c in range(4)] + [(3, 0)]
    assert {r.output for r in found} == {"[×10] INFO some event\n", "plain"}
    counted = snapshots.current_snapshot(spark, f"{folder}/metrics").first()
    assert (counted.transforms_attempted, counted.transforms_applied, counted.last_batch) == (13, 12, 1)
    assert {k: v.attempted for k, v in counted.by_tool.items()} == {"a": 8, "b": 5}
    assert set(counted.daily) == {"2024-02-03"} and counted.pass_through_reasons == {"ok": 1}
    again = chunks.record_chunks(stream, folder, F.col("who"), when, size=160)
    again.awaitTermination(240)
    assert snapshots.current_snapshot(spark, f"{folder}/metrics").first() == counted


def test_live_columns_need_no_state(spark, tmp_path):
    write_batches(tmp_path / "in", [[{"doc_id": 1, "text": '{"a": 1}'}]])
    stream = source(spark, tmp_path / "in", "doc_id long, text string")
    live = chunks.live_columns(stream).select("kind", F.col("tokens"))
    assert [tuple(r) for r in run_to_memory(live, "live", tmp_path, "append")] == [("json", 2)]
