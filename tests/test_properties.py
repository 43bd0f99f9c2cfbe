"""Properties over generated corpora: never longer, nothing lost, stable."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tersely import Options, compact_documents
from tersely.operators.hooks import (
    batch_compressor,
    batch_estimator,
    column_compressor,
    python_compressor,
    python_estimator,
)


def corpus():
    rng = random.Random(23)
    alphabet = 'ab :,"{}[]\\\n\t-0159`#.é😀\r '
    words = ["INFO x", "ERROR y", "at z:1", "Traceback", '  File "a.py"', "- k: 1", "k: v", "a,b", "```json", "```"]
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(250)]
    lines = ["\n".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(250)]
    lists = [
        json.dumps([{"id": n, "name": "n" * rng.randint(1, 5)} for n in range(rng.randint(1, 6))])
        for _ in range(100)
    ]
    return noise + lines + lists


@pytest.fixture(scope="module")
def once(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    return compact_documents(df).cache()


def test_nothing_lost_and_never_longer(once):
    rows = once.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(corpus())))
    for r in rows:
        assert r.output is not None
        if r.transformed:
            assert r.output_tokens < r.input_tokens
        assert r.output_tokens == -(-len(r.output) // 4)


def test_lists_are_stable(spark, once):
    first = once.filter("doc_id >= 500").select("doc_id", F.col("output").alias("text"))
    again = compact_documents(first).collect()
    # A text recognised as a table or tree keeps its trimmed form.
    assert all(r.output == r.text.strip() for r in again)


def test_hooks(spark, texts):
    docs = texts(['{"a": "bbbbbbbb"}' + " " * 40, "INFO a\nINFO b\nWARN c"])
    cut = column_compressor("cut", lambda text, kind: kind == "json", lambda text: F.left(text, F.lit(5)))
    rows = compact_documents(docs, options=Options(compressors=(cut,))).orderBy("doc_id").collect()
    assert rows[0].output == '{"a":' and rows[0].segments[0].reason == "compressed with plugin cut"

    def broken(text):
        raise ValueError(text)

    faulty = python_compressor("faulty", lambda text, kind: True, broken)
    short = python_compressor("short", lambda text, kind: kind == "log", lambda text: (text[:3], True))
    options = Options(compressors=(faulty, short), estimator=python_estimator("len", len))
    rows = compact_documents(docs, options=options).orderBy("doc_id").collect()
    assert rows[1].output == "INF" and rows[1].estimator == "len"
    assert rows[1].output_tokens == 3

    own = Options(transformers={"log": lambda text: F.lit("L")})
    assert compact_documents(docs, options=own).filter("doc_id = 1").first().output == "L"


def test_one_call_of_a_hook_for_a_batch(spark, texts):
    """Batch hooks give what the hooks for each segment give, in one call a batch."""
    docs = texts(['{"a": "b, c, d"}' + " " * 20, "plain words", "INFO a\nINFO b\nWARN c", '[1, "x", 3333333333]'] * 3).coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def cut(found, kinds):
        calls.add(1)
        return [text[:4] if kind == "json" else None for text, kind in zip(found, kinds)]

    whole = batch_compressor("cut", cut)
    single = python_compressor("cut", lambda text, kind: kind == "json", lambda text: (text[:4], True))
    shown = lambda options: sorted(
        (r.doc_id, r.output, r.output_tokens, r.explanations)
        for r in compact_documents(docs, options=options).collect()
    )
    one = shown(Options(compressors=(single,), estimator=python_estimator("len", len)))
    many = shown(Options(compressors=(whole,), estimator=batch_estimator("len", lambda found: list(map(len, found)))))
    assert many == one and any(row[1] == '{"a"' for row in many)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        before = calls.value
        compact_documents(docs.filter("doc_id % 4 = 1"), options=Options(compressors=(whole,))).collect()
        assert calls.value == before  # no segment is open, so nothing is asked
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wrong = batch_compressor("wrong", lambda found, kinds: [])
    with pytest.raises(Exception, match="0 results"):
        compact_documents(docs, options=Options(compressors=(wrong,))).collect()


def test_arbitrary_text_is_stable(spark):
    """A second compaction changes nothing, for texts of odd characters and structures."""
    odd = st.text(max_size=400)
    line = st.sampled_from(["ERROR a 1", "INFO b", "k: v", "- x: 1", "a,b", "a\tb", '{"a":1}', "```json", "```", "x[1]:", "  at f:1", "---", ""])
    made = st.lists(line | odd, max_size=12).map("\n".join)
    found = []

    @given(odd | made)
    @settings(max_examples=250, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    def collect(text):
        found.append(text)

    collect()
    rows = [(n, t) for n, t in enumerate(found) if not any("\ud800" <= c <= "\udfff" for c in t)]
    once = compact_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(once) == len(rows) and all(r.output is not None for r in once)
    assert all(r.output_tokens <= r.input_tokens for r in once)
    changed = [(r.doc_id, r.output) for r in once]
    again = compact_documents(spark.createDataFrame(changed, "doc_id long, text string")).collect()
    assert {r.doc_id: r.output for r in again} == dict(changed)


def test_plan_has_one_shuffle(spark, texts):
    """Python is only asked about JSON texts that repeat a key; the others pass as NULL."""
    plan = compact_documents(texts(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
