"""Table operators against small fixtures and brute force."""

from __future__ import annotations

import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tersely.functions.line_diff import kept_lines
from tersely.operators import records, reports, runs
from tersely.operators.json_docs import json_compact, json_nodes

CELL = {ord("\\"): "\\\\", ord(","): "\\,", ord("\n"): "\\n"}
STAMP = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\s*")


def brute_collapse(lines):
    out = []
    for message, run in groupby(lines, key=lambda line: STAMP.sub("", line).strip()):
        run = list(run)
        out += run if len(run) < 3 else [f"[×{len(run)}] {message}"]
    return out


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    rows = []
    for user in range(4):
        length = 900 if user == 0 else 30
        message = "a"
        for n in range(length):
            if rng.random() < 0.4:
                message = rng.choice("abc")
            rows.append((user, n, f"2024-01-01T00:00:{n % 60:02d}Z ERROR {message}"))
    return rows, spark.createDataFrame(rows, "user long, line_no long, line string")


@pytest.mark.parametrize("bucket_rows", [None, 1, 7, 50, 10**9])
def test_runs_match_brute_force(log, bucket_rows):
    rows, df = log
    bucket = None if bucket_rows is None else F.floor(F.col("line_no") / bucket_rows)
    out = runs.collapse_line_runs(df, ["user"], ["line_no"], bucket=bucket)
    got = {}
    for row in sorted(out.collect(), key=lambda r: (r.user, r.line_no)):
        got.setdefault(row.user, []).append(row.line)
    for user in range(4):
        assert got[user] == brute_collapse([line for u, _, line in rows if u == user])


def test_one_shuffle_for_runs(log):
    _, df = log
    plan = runs.line_runs(df, ["user"], ["line_no"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan


@pytest.mark.parametrize("fanout, depth", [(2, 1), (2, 2), (2, 9), (3, 4), (1024, 3)])
def test_runs_are_the_same_for_any_depth(spark, log, fanout, depth):
    """Runs that go on over many buckets, negative ones and gaps included."""
    _, df = log
    shifted = df.withColumn("line_no", F.col("line_no") - 150)
    plain = runs.line_runs(shifted, ["user"], ["line_no"])
    tree = runs.line_runs(
        shifted, ["user"], ["line_no"], bucket=F.floor(F.col("line_no") / 4), fanout=fanout, depth=depth
    )
    assert sorted(map(str, tree.collect())) == sorted(map(str, plain.collect()))


def test_windows_of_runs_hold_a_bucket(log):
    """Lines are dealt by key and bucket; by key alone only the ends the last level joins."""
    _, df = log
    tree = runs.line_runs(df, ["user"], ["line_no"], bucket=F.floor(F.col("line_no") / 50), depth=3)
    plan = tree._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert sum("_part" not in columns for columns in dealt) == 1
    assert len(set(dealt)) > 1


def test_pack_records(spark):
    df = spark.createDataFrame(
        [(1, 2, "a,b"), (1, 1, None), (1, 3, "x\\y\nz"), (2, 1, "q")], "k int, id int, v string"
    )
    packed = {r.k: r for r in records.pack_records(df, ["k"], ["id"], ["id", "v"], "rows").collect()}
    assert packed[1].block == "rows[3]{id,v}:\n  1,null\n  2,a\\,b\n  3,x\\\\y\\nz\n"
    split = records.pack_records(
        df, ["k"], ["id"], ["id", "v"], "rows", bucket=F.floor(F.col("id") / 2)
    )
    blocks = sorted((r.k, r.block_no, r.n) for r in split.collect())
    assert blocks == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]
    for by in (None, F.floor(F.col("id") / 2), F.col("id")):
        for size in (1, 2, 3, 10):
            cut = records.pack_records(df, ["k"], ["id"], ["id", "v"], "rows", by, rows_per_block=size)
            ids = [(1, "1,null"), (1, "2,a\\,b"), (1, "3,x\\\\y\\nz"), (2, "1,q")]
            expected = set()
            for k in (1, 2):
                own = [text for key, text in ids if key == k]
                for no, at in enumerate(range(0, len(own), size)):
                    part = own[at : at + size]
                    body = "".join(f"  {text}\n" for text in part)
                    expected.add((k, no, len(part), f"rows[{len(part)}]{{id,v}}:\n{body}"))
            assert {tuple(r) for r in cut.collect()} == expected
    no_key = spark.createDataFrame([(None, 1), (None, 2), (None, 3)], "k int, id int")
    cut = records.pack_records(no_key, ["k"], ["id"], ["id"], "rows", F.col("id"), rows_per_block=2)
    assert sorted((r.block_no, r.n) for r in cut.collect()) == [(0, 2), (1, 1)]
    lines = records.pack_lines(df, ["k"], ["id"], ["id", "v"], "rows")
    ordered = [r.line for r in lines.filter("k = 1").orderBy("part", "id").collect()]
    assert "\n".join(ordered) + "\n" == packed[1].block


def reference_lines(value, name, depth):
    """Compact lines of a parsed JSON value, from the format rules."""
    pad = "  " * depth

    def word(v):
        return {True: "true", False: "false", None: "null"}[v] if v is None or v is True or v is False else str(v)

    def cell(v):
        return word(v).translate(CELL)

    if isinstance(value, dict):
        body = [line for k, v in value.items() for line in reference_lines(v, k, depth + 1)]
        return [pad + ("-" if name == "-" else f"{name}:")] + body
    if isinstance(value, list):
        flat = value and all(
            isinstance(v, dict)
            and v
            and list(v) == list(value[0])
            and not any(isinstance(x, (dict, list)) for x in v.values())
            for v in value
        )
        if flat:
            head = f"{pad}{name}[{len(value)}]{{{','.join(value[0])}}}:"
            return [head] + [pad + "  " + ",".join(map(cell, v.values())) for v in value]
        body = [line for v in value for line in reference_lines(v, "-", depth + 1)]
        return [f"{pad}{name}[{len(value)}]:"] + body
    return [pad + (f"- {word(value)}" if name == "-" else f"{name}: {word(value)}")]


def random_json(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice([1, -7, 2.5, 1e20, 1e-7, True, None, "", "x,y", "é\n\"q\"", "[{]}", "a\\b"])
    if kind < 0.55:
        keys = rng.sample(["id", "name", "k:1", "x y"], rng.randint(1, 3))
        return [{k: random_json(rng, 0) for k in keys} for _ in range(rng.randint(0, 4))]
    if kind < 0.75:
        return [random_json(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {k: random_json(rng, depth - 1) for k in rng.sample("abcdef", rng.randint(0, 4))}


def test_json_compact_matches_brute_force(texts):
    import json

    rng = random.Random(3)
    values = [random_json(rng, 4) for _ in range(300)]
    forms = [None, 2]
    docs = [json.dumps(v, indent=rng.choice(forms), ensure_ascii=rng.random() < 0.5) for v in values]
    got = {r.doc_id: r.compact for r in json_compact(texts(docs)).collect()}
    for n, value in enumerate(values):
        if value == "-":
            continue
        assert got[n] == "\n".join(reference_lines(value, "data", 0)) + "\n", docs[n]


def test_json_nodes(texts):
    rows = json_nodes(texts(['{"a": [1, {"b": "x"}], "c": {}}'])).orderBy("pos").collect()
    assert [(r.depth, r.key, r.kind, r.value, r.children) for r in rows] == [
        (0, None, "object", None, 2),
        (1, "a", "array", None, 2),
        (2, None, "number", "1", None),
        (2, None, "object", None, 1),
        (3, "b", "string", "x", None),
        (1, "c", "object", None, 0),
    ]


def test_changed_lines_and_sets(spark):
    df = spark.createDataFrame(
        [(1, "a\nb\nb", "a\nb\nc"), (2, "same", "same")], "doc_id int, text string, output string"
    )
    got = {(r.doc_id, r.sign, r.line, r.n) for r in reports.changed_lines(df).collect()}
    assert got == {(1, "-", "b", 1), (1, "+", "c", 1)}
    one = spark.createDataFrame([("x",), ("y",)], "tool string")
    two = spark.createDataFrame([("y",), ("z",)], "tool string")
    sides = {(r.tool, r.side) for r in reports.set_difference(one, two).collect()}
    assert sides == {("x", "left"), ("z", "right")}
    assert reports.set_difference(one, one).isEmpty()


def subsequences(a, b):
    """Length of the longest common subsequence, by the textbook table."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_line_changes_rebuild_both_texts(spark):
    """Kept and removed lines are the text before, kept and added ones the text after."""
    rng = random.Random(11)
    rows = [(7, None, "a"), (7, "a", None), (7, "", ""), (None, "x\ny", "y\nx"), (7, "same", "same")]
    for n in range(150):
        words = "abcdefghij"[: rng.randint(2, 10)]
        before = [rng.choice(words) for _ in range(rng.randint(0, 14))]
        after = [w for w in before if rng.random() < 0.8]
        for _ in range(rng.randint(0, 3)):
            after.insert(rng.randint(0, len(after)), rng.choice(words))
        rows.append((n % 5, "\n".join(before), "\n".join(after)))
    for at in range(0, len(rows), 31):
        _, before, after = rows[at]
        df = spark.createDataFrame([rows[at]], "doc_id int, text string, output string")
        found = reports.line_changes(df).orderBy("place").collect()
        lines = lambda text: (text or "").split("\n") if text else []
        assert [r.line for r in found if r.sign in " -"] == lines(before)
        assert [r.line for r in found if r.sign in " +"] == lines(after)
        assert [r.before_no for r in found if r.before_no] == list(range(1, len(lines(before)) + 1))
        assert [r.after_no for r in found if r.after_no] == list(range(1, len(lines(after)) + 1))
    whole = spark.createDataFrame(rows, "doc_id int, text string, output string")
    counts = reports.line_changes(whole).groupBy("sign").count().collect()
    before = sum(len(lines(b)) for _, b, _ in rows)
    assert sum(r["count"] for r in counts if r.sign in " -") == before
    kept = sum(r["count"] for r in counts if r.sign == " ")
    assert reports.line_changes(whole, keep=False).count() == sum(r["count"] for r in counts) - kept
    assert reports.line_changes(whole.limit(0)).count() == 0


def test_kept_lines_rise_and_are_longest_where_lines_are_unique():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 9))] for _ in range(2))
        kept = kept_lines(a, b)
        assert all(a[i] == b[j] for i, j in kept)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(kept, kept[1:]))
        a, b = (rng.sample(range(12), rng.randint(0, 12)) for _ in range(2))
        assert len(kept_lines(a, b)) == subsequences(a, b)


def test_rows_that_share_an_id_are_compared_apart(spark):
    df = spark.createDataFrame([(1, "a\nb", "a"), (1, "a", "a\nb")], "doc_id int, text string, output string")
    got = sorted((r.sign, r.line, r.n) for r in reports.changed_lines(df).collect())
    assert got == [("+", "b", 1), ("-", "b", 1)]
    rows = spark.createDataFrame([(["a", "b", "a"], ["b", "a"]), (["a"], ["a", "c"])], "x array<string>, y array<string>")
    same = rows.select(reports.same_members(F.col("x"), F.col("y")), reports.same_members(F.col("x"), ["a"]))
    assert [tuple(r) for r in same.collect()] == [(True, False), (False, True)]


def test_metrics(spark):
    rows = [
        ("a", "2024-01-01 10:00:00", True, 10, 4, "ok"),
        (" a ", "2024-01-02 10:00:00", False, 10, 10, "no"),
        ("  ", "2024-01-02 11:00:00", True, 7, 8, "ok"),
    ]
    df = spark.createDataFrame(
        rows, "tool string, ts string, transformed boolean, input_tokens long, output_tokens long, reason string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    total = reports.metrics_totals(df).first()
    assert tuple(total) == (3, 2, 1, 5)
    cube = {(r.scope, r.tool or str(r.day)): (r.attempted, r.tokens_saved) for r in reports.metrics_cube(df).collect()}
    assert cube[("tool", "unknown")] == (1, -1)
    assert cube[("day", "2024-01-02")] == (2, -1)
    assert cube[("total", "None")] == (3, 5)
    daily = reports.apply_ratio(reports.metrics_daily(df))
    assert {str(r.day): r.percent for r in daily.collect()} == {"2024-01-01": 100, "2024-01-02": 50}
