"""Files in and out: texts, audit and event records, snapshots, baselines."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tersely.operators import reports
from tersely.operators.compact import compact_documents
from tersely.schemas import AUDIT
from tersely.sources import audit_log, snapshots, texts as text_files


def test_read_texts(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.prompt").write_text("one\ntwo\n")
    (tmp_path / "deep" / "b.prompt").write_text("three")
    (tmp_path / "c.txt").write_text("no")
    found = text_files.read_texts(spark, str(tmp_path), ".prompt").collect()
    assert sorted(r.text for r in found) == ["one\ntwo\n", "three"]
    df = text_files.read_texts(spark, str(tmp_path), ".prompt")
    assert reports.within_budget(df, 2) and not reports.within_budget(df, 1)


@pytest.fixture(scope="module")
def audited(spark, tmp_path_factory):
    docs = spark.createDataFrame(
        [(n, "a" if n % 2 else "", "INFO some event\n" * (n + 1)) for n in range(6)],
        "doc_id long, tool string, text string",
    )
    results = compact_documents(docs).cache()
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 43200)
    rows = audit_log.audit_rows(results, F.col("tool"), when, "1", "s")
    path = str(tmp_path_factory.mktemp("audit"))
    audit_log.append_records(rows, path)
    return results, path


def test_audit_round_trip(spark, audited):
    _, path = audited
    audit = audit_log.read_audit(spark, path)
    assert audit.count() == 6
    one = audit_log.filter_audit(audit, "2024-01-02", "unknown").collect()
    assert [r.ts for r in one] == ["2024-01-02T00:00:00.000000+00:00"]
    assert one[0].delta_tokens == one[0].output_tokens_est - one[0].input_tokens_est
    last = audit_log.tail_audit(audit, 2).collect()
    assert [r.ts[:10] for r in last] == ["2024-01-03", "2024-01-03"]
    plan = audit_log.filter_audit(audit, "2024-01-02")._jdf.queryExecution().executedPlan()
    filters = plan.toString().split("PartitionFilters:")[1].split("]")[0]
    assert "StartsWith(day" in filters


def test_audit_bad_line_raises(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"ts": "2024"}\nnot json\n')
    with pytest.raises(Exception):
        audit_log.read_audit(spark, str(tmp_path)).collect()


def test_audit_switched_off(spark, audited, tmp_path):
    results, _ = audited
    target = tmp_path / "off"
    rows = audit_log.event_rows(results, F.current_timestamp())
    audit_log.append_records(rows, str(target), enabled=False)
    assert not target.exists()


def test_event_hash_follows_redaction(audited):
    results, _ = audited
    when = F.timestamp_seconds(F.lit(0))
    assert audit_log.event_rows(results, when).first().prompt_hash is not None
    bare = audit_log.event_rows(results, when, redaction=False).first()
    assert bare.prompt_hash is None and bare.segment_types == ["plain"]


def test_snapshot_round_trip(spark, audited, tmp_path):
    results, _ = audited
    rows = results.withColumn("ts", F.timestamp_seconds(F.lit(0)))
    path = str(tmp_path / "snap")
    snapshots.write_snapshot(snapshots.snapshot(rows), path)
    got = snapshots.read_snapshot(spark, path).first()
    assert got.transforms_attempted == 6
    assert got.transforms_applied + got.pass_through == 6
    assert set(got.by_tool) == {"a", "unknown"} and set(got.daily) == {"1970-01-01"}
    assert sum(got.pass_through_reasons.values()) == got.pass_through


@pytest.mark.parametrize("body", ["{not json", "[]", '"x"', ""])
def test_damaged_snapshot_is_empty(spark, tmp_path, body):
    (tmp_path / "m.json").write_text(body)
    got = snapshots.read_snapshot(spark, str(tmp_path)).collect()
    assert all(r.transforms_attempted == 0 and r.by_tool == {} for r in got)


def test_odd_snapshot_is_cleaned(spark, tmp_path):
    block = {"attempted": 2, "applied": 1, "pass_through": 1, "delta": -3}
    body = {
        "transforms_attempted": -1,
        "transforms_applied": 4,
        "pass_through": "x",
        "pass_through_reasons": {"ok": 2, "bad": -1, "worse": "n"},
        "by_tool": {"a": block, "b": {**block, "applied": -1}, "c": {"attempted": 1}, "d": 7},
        "daily": 3,
    }
    (tmp_path / "m.json").write_text(json.dumps(body))
    got = snapshots.read_snapshot(spark, str(tmp_path)).first()
    assert (got.transforms_attempted, got.transforms_applied, got.pass_through) == (0, 4, 0)
    assert got.pass_through_reasons == {"ok": 2}
    assert set(got.by_tool) == {"a"} and got.by_tool["a"].delta == -3
    assert got.daily == {}


def counter_rows(snap):
    return sorted(map(str, snapshots.snapshot_rows(snap).collect()))


def made_results(spark, n, first=0):
    rows = [
        ("ab "[i % 3], f"2024-01-0{1 + i % 4} 10:00:00", i % 2 == 0, 20 + i, 10, f"why {i % 2}")
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(
        rows, "tool string, ts string, transformed boolean, input_tokens long, output_tokens long, reason string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))


def test_updates_equal_one_recomputation(spark, tmp_path):
    """Batches add up; a number that comes again, or late, changes nothing."""
    path = str(tmp_path / "kept")
    assert snapshots.current_snapshot(spark, path).first().last_batch == -1
    assert snapshots.update_snapshot(made_results(spark, 10), path, 0)
    assert snapshots.update_snapshot(made_results(spark, 13, 10), path, 1)
    whole = counter_rows(snapshots.snapshot(made_results(spark, 23)))
    assert counter_rows(snapshots.current_snapshot(spark, path)) == whole
    assert not snapshots.update_snapshot(made_results(spark, 5), path, 1)
    assert not snapshots.update_snapshot(made_results(spark, 5), path, 0)
    assert counter_rows(snapshots.current_snapshot(spark, path)) == whole
    assert snapshots.update_snapshot(made_results(spark, 0), path, 7)
    now = snapshots.current_snapshot(spark, path)
    assert counter_rows(now) == whole and now.first().last_batch == 7
    assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == ["slot=0", "slot=1"]


def test_a_damaged_slot_leaves_the_other(spark, tmp_path):
    """A write that broke off in the slot that was free does not touch the current state."""
    path = tmp_path / "kept"
    for batch in (0, 1):
        snapshots.update_snapshot(made_results(spark, 4, 4 * batch), str(path), batch)
    slot = snapshots.current_snapshot(spark, str(path)).first().slot
    for file in (path / f"slot={1 - slot}").glob("part-*"):
        file.write_text('{"last_batch":2,"transf')
    for file in (path / f"slot={1 - slot}").glob(".part-*"):
        file.unlink()
    whole = counter_rows(snapshots.snapshot(made_results(spark, 8)))
    assert counter_rows(snapshots.current_snapshot(spark, str(path))) == whole
    assert snapshots.update_snapshot(made_results(spark, 2, 8), str(path), 2)
    whole = counter_rows(snapshots.snapshot(made_results(spark, 10)))
    assert counter_rows(snapshots.current_snapshot(spark, str(path))) == whole


def test_folding_any_grouping(spark):
    parts = [snapshots.snapshot(made_results(spark, n, at)) for at, n in ((0, 3), (3, 1), (4, 8))]
    left = snapshots.folded(snapshots.folded(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    right = snapshots.folded(parts[2].unionByName(parts[1]).unionByName(parts[0]))
    whole = counter_rows(snapshots.snapshot(made_results(spark, 12)))
    assert counter_rows(left) == counter_rows(right) == whole


def test_tail_follows_the_files(spark, tmp_path):
    """Equal and even falling times come in the order in which they were appended."""
    path = str(tmp_path / "log")
    names = [f.strip().split(" ")[0] for f in AUDIT.split(",")]
    for at in range(3):
        rows = [
            tuple(f"2024-0{5 - at}-01T00" if c == "ts" else 100 * at + n if c == "duration_ms" else None for c in names)
            for n in range(20)
        ]
        audit_log.append_records(spark.createDataFrame(rows, AUDIT).coalesce(1), path)
    audit = audit_log.read_audit(spark, path)
    last = [r.duration_ms for r in audit_log.tail_audit(audit, 25).collect()]
    assert last == [*range(115, 120), *range(200, 220)]
    some = audit.filter("duration_ms % 7 = 0")
    assert [r.duration_ms for r in audit_log.tail_audit(some, 3).collect()] == [203, 210, 217]
    assert audit_log.tail_audit(audit, 1, by_time=True).first().ts == "2024-05-01T00"
    assert set(audit_log.tail_audit(audit, 1).columns) == {*names, "day", "append"}


def test_baseline(spark, tmp_path):
    rows = [("same", 41.0, 34.0, -17.07), ("worse", 44.0, 40.0, -9.0), ("new", 1.0, 1.0, 0.0)]
    current = spark.createDataFrame(rows, "name string, input_tokens double, output_tokens double, delta_pct double")
    path = str(tmp_path / "base")
    old = current.filter("name <> 'new'").withColumn(
        "delta_pct", F.when(F.col("name") == "worse", -14.01).otherwise(F.col("delta_pct"))
    )
    snapshots.write_baseline(old, path)
    checked = reports.regression_check(current, snapshots.read_baseline(spark, path))
    assert {r.name: r.verdict for r in checked.collect()} == {
        "same": "ok",
        "worse": "regression",
        "new": "missing baseline fixture",
    }


def test_missing_audit_path_is_empty(spark, tmp_path):
    assert audit_log.read_audit(spark, str(tmp_path / "none")).count() == 0
