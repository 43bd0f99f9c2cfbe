"""The pipeline's stages on a small corpus, and the whole over the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from tersely.llm.common import text_key


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "pii", "bpe"]


def test_each_stage_takes_effect(spark, sf, tmp_path):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, rows = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns and out.dtypes == documents.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows.append(docs.count())
    assert rows[0] > rows[1] > rows[2] >= rows[3] == rows[4] > 0
    assert docs.where("text RLIKE '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == rows[4]
    assert corpus_pipeline.run(spark, sf).exceptAll(last).count() == 0


def test_repeated_rows_and_nulls(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, text + ".", "xx", "s", 3), (None, None, None, None, None),
            (3, text, "en", None, 1), (None, "other words without an id stand here", "xx", "s", 9)]
    docs = spark.createDataFrame(rows, schema)
    once = corpus_pipeline.one_of_each(spark, docs, sf)
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "2", "None", "None"]
    left = corpus_pipeline.no_test_passages(spark, docs, sf)
    assert left.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert docs.select(text_key()).where("xxhash64(coalesce(text, '')) IS NULL").count() == 0
