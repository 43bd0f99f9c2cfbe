"""Golden texts, published token figures and decision reasons."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tersely import Options, compact_documents
from tersely.functions.json_text import with_last_values
from tersely.operators.compact import NOT_SHORTER, segment_breakdown
from tersely.operators.json_docs import json_compact, json_nodes

ERRORS = '{"code":502,"message":"upstream timeout"}'
REPEATED_LOGS = "".join(f"2026-04-12T10:00:0{n}Z ERROR database timeout\n" for n in range(4))
NESTED = (
    '{"nodes":[{"id":1,"name":"Node 1","children":[{"id":2,"name":"Node 1.1"},'
    '{"id":3,"name":"Node 1.2"}]},{"id":4,"name":"Node 2","children":[{"id":5,'
    '"name":"Node 2.1"},{"id":6,"name":"Node 2.2"}]}]}\n'
)
MIXED = (
    "Find the bug in this API flow.\n\n```json\n"
    f'{{"service":"checkout","errors":[{ERRORS},{ERRORS}]}}\n```\n'
)
# Texts and results that must be met exactly.
GOLDEN = {
    "json_nodes": (
        '{"nodes":[{"id":1,"name":"Node 1"},{"id":2,"name":"Node 2"}]}\n',
        "data:\n  nodes[2]{id,name}:\n    1,Node 1\n    2,Node 2\n",
    ),
    "log_lines": (REPEATED_LOGS[:88], REPEATED_LOGS[:88]),
    "malformed_json": ('{"nodes":[{"id":1,"name":"Node 1"},]}\n',) * 2,
    "mixed_fenced_json": (
        "Investigate these API failures and summarize the cause.\n\n```json\n"
        f'{{"errors":[{ERRORS},{ERRORS},{ERRORS}]}}\n```\n',
        "Investigate these API failures and summarize the cause.\n\ndata:\n"
        "  errors[3]{code,message}:\n" + "    502,upstream timeout\n" * 3 + "\n",
    ),
    "mixed_plain": ("Explain why the API is failing.\n",) * 2,
    "empty": ("", ""),
    "blank": (" \n ", " \n "),
    "fence_vanishes": ("see\n```python\nx = 1\n```\n", "see\nx = 1\n\n"),
    "unclosed_fence": ("see ```json\n{}", "see ```json\n{}"),
    "run_of_two": (
        "INFO a\nINFO a\nERROR bb\nERROR bb\n",
        "INFO a\nINFO a\nERROR bb\nERROR bb\n",
    ),
    "run_of_three": ("INFO some event\n" * 3, "[×3] INFO some event\n"),
    "deep": (
        '{"a": {"b": [ [1, 2], {"c": null, "d": [true, {"e": "x"}]} ], "empty": [], "none": {}}}'
        + " " * 150,
        "data:\n  a:\n    b[2]:\n      -[2]:\n        - 1\n        - 2\n      -\n        c: null\n"
        "        d[2]:\n          - true\n          -\n            e: x\n    empty[0]:\n    none:\n",
    ),
    "cells": (
        '[{"a, b": "x,y", "c": "p\\\\q"}, {"a, b": "l1\\nl2", "c": "\\u00e9"}]' + " " * 20,
        "data[2]{a, b,c}:\n  x\\,y,p\\\\q\n  l1\\nl2,é\n",
    ),
    "mixed_list": (
        '{"items": [{"k": 1.50, "name": "first"}, {"name": "second", "k": 1e3}, 7]}' + " " * 150,
        "data:\n  items[3]:\n    -\n      k: 1.5\n      name: first\n    -\n      name: second\n"
        "      k: 1000.0\n    - 7\n",
    ),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, text) for name, (text, _) in GOLDEN.items()]
    rows += [("nested_nodes", NESTED), ("repeated_logs", REPEATED_LOGS), ("mixed_prompt", MIXED)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    return {row.doc_id: row for row in compact_documents(docs).collect()}


@pytest.mark.parametrize("name", list(GOLDEN))
def test_golden(results, name):
    assert results[name].output == GOLDEN[name][1]


@pytest.mark.parametrize(
    "name, before, after",
    [("mixed_prompt", 41, 34), ("nested_nodes", 49, 49), ("repeated_logs", 44, 7)],
)
def test_published_token_figures(results, name, before, after):
    assert (results[name].input_tokens, results[name].output_tokens) == (before, after)


def test_reasons(results):
    assert results["nested_nodes"].reason == NOT_SHORTER
    assert results["nested_nodes"].output == NESTED
    vanished = results["fence_vanishes"]
    assert (vanished.action, vanished.reason, vanished.transformed) == ("pass-through", "ok", False)
    logs = results["repeated_logs"]
    assert logs.explanations == ["log: compressed with plugin builtin.log"]
    assert results["empty"].segments == []


def test_options(spark, texts):
    table = "a,b\n" * 30
    log = "INFO some event\n" * 3
    big = "x" * 200
    fenced = "see\n```json\n" + "[1, 2, 3]" * 30 + "\n```\n"
    docs = texts([table, log, big, fenced, None])

    def run(**settings):
        rows = compact_documents(docs, options=Options(**settings)).orderBy("doc_id").collect()
        assert [row.doc_id for row in rows] == [0, 1, 2, 3, 4]
        return [(row.action, row.reason, [s.reason for s in row.segments or []]) for row in rows]

    base = run()
    assert base[0][2] == ["compression score below threshold; kept original"]
    off = run(rules={"logs": False})
    assert off[1][2] == ["compression disabled by config; kept original"]
    assert run(threshold=0.1)[0][2] == ["compressed table into compact format"]
    small = run(max_input_bytes=199)
    assert small[2][:2] == ("pass-through", "input exceeds max_input_bytes")
    assert small[3][:2] == ("pass-through", "input exceeds max_input_bytes")
    assert run(max_input_bytes=200)[2][1] == "ok"
    other = run(format_version="9")
    assert {row[1] for row in other} == {"unsupported format version 9"}
    repeated = texts(['{"a": 1, "b": 2, "a": {"c": [3]}}' + " " * 90])
    fenced = "x\n\n```json\n{\"k\": [1], \"k\": 2}     \n```\ny\n```\n [{\"k\": [1], \"k\": 2}] \n```\n[1,\n{\"k\": 3, \"k\": 4}]\n"
    (row,) = compact_documents(texts([fenced]), options=Options(threshold=0.0)).collect()
    assert [s.new_text for s in row.segments if s.kind == "json"] == [
        "data:\n  k: 2\n", "data[1]{k}:\n  2\n", "data[2]:\n  - 1\n  -\n    k: 4\n"
    ]
    assert compact_documents(repeated).first().output == "data:\n  a:\n    c[1]:\n      - 3\n  b: 2\n"


def _made_json(rng, depth=0):
    """JSON text whose objects often repeat a key, some in another spelling."""
    kind = rng.random()
    if depth > 4 or kind < 0.3:
        return rng.choice(["1", "-2.50", '"x, {"', "null", "true", '"\\u0041"', '"\\\\"', "1e3"])
    items = [_made_json(rng, depth + 1) for _ in range(rng.randrange(5))]
    if kind < 0.55:
        return "[" + " , ".join(items) + "]"
    keys = ['"a"', '"\\u0061"', '"b"', '"b "', '"{"', '""', '"\\\\"']
    return "{ " + ",".join(f"{rng.choice(keys)} : {item}" for item in items) + "}"


def _pairs(found):
    assert len({key for key, _ in found}) == len(found)
    return dict(found)


def test_last_value_of_a_repeated_key():
    """As a JSON reader with maps has it, at any depth, other tokens untouched."""
    rng = random.Random(5)
    for _ in range(500):
        text = _made_json(rng)
        out = with_last_values(text)
        shown = lambda value: json.dumps(value, ensure_ascii=True)
        assert shown(json.loads(out, object_pairs_hook=_pairs)) == shown(json.loads(text))
        assert with_last_values(out) == out
    deep = '{"a":1,"a":' * 5000 + "2" + "}" * 5000
    assert with_last_values(deep) == '{"a":' * 5000 + "2" + "}" * 5000


def test_repeated_keys_in_nodes_and_blocks(spark, texts):
    """Whole overridden subtrees go; a flat list keeps its table form."""
    docs = texts(['{"a":{"b":{"c":1}},"d":[{"x":1,"x":[2]}],"a":5}', '[{"k":1,"k":2},{"k":3}]', '{"a":1}'])
    nodes = [(r.doc_id, r.depth, r.key, r.kind, r.value, r.children) for r in json_nodes(docs).orderBy("doc_id", "pos").collect()]
    assert nodes[:6] == [
        (0, 0, None, "object", None, 2),
        (0, 1, "a", "number", "5", None),
        (0, 1, "d", "array", None, 1),
        (0, 2, None, "object", None, 1),
        (0, 3, "x", "array", None, 1),
        (0, 4, None, "number", "2", None),
    ]
    blocks = {r.doc_id: r.compact for r in json_compact(docs).collect()}
    assert blocks[0] == "data:\n  a: 5\n  d[1]:\n    -\n      x[1]:\n        - 2\n"
    assert blocks[1] == "data[2]{k}:\n  2\n  3\n" and blocks[2] == "data:\n  a: 1\n"


def test_breakdown(spark, texts):
    docs = texts(["x\n\n```json\n{\"a\":[1]}\n```\nend one\nend two\n", MIXED])
    rows = segment_breakdown(compact_documents(docs)).orderBy("doc_id", "seg_no").collect()
    shown = [(r.doc_id, r.seg_no, r.type, r.source, r.line_start, r.line_end) for r in rows]
    assert shown == [
        (0, 1, "plain", "plain", 1, 2),
        (0, 2, "json", "fenced-json", 4, 4),
        (0, 3, "plain", "mixed-tail", 5, 7),
        (1, 1, "plain", "plain", 1, 2),
        (1, 2, "json", "fenced-json", 4, 4),
        (1, 3, "plain", "plain", 5, 5),
    ]
    assert rows[4].changed and rows[4].tokens_saved > 0


def test_repeated_and_missing_ids(spark):
    """Each input row gives one output row, also where ids repeat or are NULL."""
    rows = [(1, '{"a": [{"x": 1}, {"x": 2}]}'), (1, '{"b": 3}'), (1, '{"b": 3}'), (None, "[1, 2]"), (None, "words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = compact_documents(df).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, rows))
    alone = {r.text: r.output for r in compact_documents(df.distinct().withColumn("doc_id", F.hash("text"))).collect()}
    assert all(r.output == alone[r.text] for r in compact_documents(df).collect())
