"""The corpus pipeline: reject bad text, near copies and test passages, mask, encode.

Each stage takes and returns a table of documents, written as Parquet in between; only
the last returns something else. When a stage begins, the result of the one before has been
written, so what that one left in the scratch folder is deleted; shuffle files go with the
query that wrote them, and Python workers get small batches (settings of the session).
Verdicts are joined back by document id and text hash,
so ids may repeat or be null. Null and empty texts are rejected by the first stage. An
empty table passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm import bpe, decontaminate, near_copies, pii, quality
from tersely.llm.common import BATCH_BYTES, CLEANUP, discard, noted, table, text_key, written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SHINGLE, PERCENT, WINDOW = 5, 80, 13


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text hash are among ``rejected``."""
    out = rejected.select(F.col("doc_id").alias("out_id"), F.col("doc_key").alias("out_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("out_id")) & (text_key() == F.col("out_key"))
    return docs.join(out, same, "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models of trusted text do not reject."""
    judged = quality.quality(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("NOT kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies; of repeated rows one."""
    found = near_copies.near_copies(docs, shingle=SHINGLE, percent=PERCENT)
    names = docs.columns
    rest = _without(docs, found.where("NOT kept")).withColumn("_key", text_key())
    return rest.dropDuplicates(["doc_id", "_key"]).select(names)


def no_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 stands in a benchmark window."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), window=WINDOW)
    return _without(docs, decontaminate.judged(found).where("contaminated"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text decoded from them, as digests."""
    return bpe.bpe_digests(docs, VOCABULARY)


#: Scratch folders of the stage that ran last.
_left: list[str] = []


def _released(stage: Callable) -> Callable:
    """``stage``, which first deletes what the stage before has left."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in ({CLEANUP: "true"} | BATCH_BYTES).items():
            spark.conf.set(key, value)
        files = docs.inputFiles()
        if not any(folder in file for folder in _left for file in files):
            discard(_left)
        with noted(_left):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality", _released(good_quality)),
    ("near_copies", _released(one_of_each)),
    ("decontaminate", _released(no_test_passages)),
    ("pii", _released(masked)),
    ("bpe", _released(encoded)),
]

#: SQL cannot express the classifier or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with noted([]) as made:
            docs = written(result, f"pipeline-{name}")
        discard(before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
