"""The quality models are fitted on half of all labelled documents, however many there are."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tersely.llm import quality


class Seen(Exception):
    pass


def test_half_of_all_trusted_documents_is_fitted(spark, tmp_path, monkeypatch):
    rows = spark.range(9_000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), F.col("id")).alias("text")
    )
    rows.write.parquet(str(tmp_path / "docs"))
    labels = rows.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))

    def fitted(sample):
        raise Seen(sample.count())

    monkeypatch.setattr(quality, "fitted", fitted)
    with pytest.raises(Seen, match="^4500$"):
        quality.quality(spark.read.parquet(str(tmp_path / "docs")), labels)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 500])
def test_index_finds_what_it_holds(size):
    rng = np.random.default_rng(size)
    known = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    if size > 2:
        known = np.unique(np.concatenate([known, np.array([0, 5, 6, 7, 2**64 - 1], dtype=np.uint64)]))
    asked = np.concatenate([known, rng.integers(0, 2**64, 300, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    at, there = quality.Index(known).places(asked)
    assert there.tolist() == np.isin(asked, known).tolist()
    assert (known[at[there]] == asked[there]).all()
