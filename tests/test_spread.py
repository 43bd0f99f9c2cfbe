"""Rows of one partition are worked on in all of them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tersely.functions.json_text import resolved
from tersely.operators.compact import compact_documents
from tersely.operators.json_docs import json_compact, json_nodes
from tersely.streaming.chunks import compact_chunks


def one_partition(spark, text):
    return spark.range(64, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))


@pytest.mark.parametrize("work", [compact_documents, lambda docs: compact_chunks(docs, 40)])
def test_texts_decided_in_their_row_are_spread(spark, work):
    docs = one_partition(spark, F.concat(F.repeat(F.lit("ERROR order is late\n"), 5), F.col("id")))
    found = work(docs).select("doc_id", F.spark_partition_id().alias("part")).collect()
    assert {r.doc_id for r in found} == set(range(64))
    assert len({r.part for r in found}) > 1


@pytest.mark.parametrize("work", [compact_documents, json_compact, json_nodes])
def test_texts_are_spread_before_their_keys_are_compared(spark, work):
    """The Python step that keeps the last of repeated keys comes after a shuffle."""
    docs = one_partition(spark, F.concat(F.lit('{"a":1,"a":'), F.col("id"), F.lit("}")))
    plan = work(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[plan.index("ArrowEvalPython") :]


def test_resolved_among_texts_without_repeated_keys(spark):
    texts = ['{"a":1}', '{"a":1,"b":2}', '{"a":1,"a":2}', None, "prose: a: b", '[{"b":1,"c":{"b":2}},{"b":[],"b":"x:y"}]']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = docs.select("doc_id", resolved(F.array("text")).alias("own")).collect()
    assert {r.doc_id: r.own for r in found if r.own} == {
        2: ['{"a":2}'],
        5: ['[{"b":1,"c":{"b":2}},{"b":"x:y"}]'],
    }
    assert json.loads(found[5].own[0])[1] == {"b": "x:y"}
