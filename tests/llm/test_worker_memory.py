"""What an operator keeps in a worker process does not stay there beside the next one's work."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest

from tersely.llm import bpe, near_copies, pii

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


class Rows:
    """Stands for a DataFrame; runs the step of its ``mapInArrow`` in this process."""

    schema, columns = None, ["doc_id", "text"]

    def __init__(self, **columns):
        self.batch = pa.record_batch(columns)

    def select(self, *names):
        return self

    def mapInArrow(self, step, schema):  # noqa: N802
        return list(step(iter([self.batch])))


TEXTS = {"doc_id": [1, 2], "text": ["one two three four five six", None]}


@pytest.mark.parametrize(
    "work",
    [
        lambda: near_copies.features(Rows(doc_id=[1], doc_key=[2], has_id=[True], text=["a b c"]), 5),
        lambda: near_copies.packed_sets(Rows(**TEXTS), 5),
        lambda: pii.mask_pii(Rows(**TEXTS)),
    ],
)
def test_vocabulary_leaves_the_worker(work):
    first = bpe.coder(VOCABULARY)
    assert bpe.coder(VOCABULARY) is first
    assert work()
    assert bpe.coder(VOCABULARY) is not first


def test_vocabulary_stays_for_the_next_task(spark):
    first = bpe.coder(VOCABULARY)
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    step = []
    docs.mapInArrow, before = lambda run, schema: step.append(run) or before(run, schema), docs.mapInArrow
    assert bpe.encode_documents(docs, VOCABULARY).count() == 2
    assert list(step[0](iter([pa.record_batch(TEXTS)])))
    assert bpe.coder(VOCABULARY) is first


def test_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    given = []
    monkeypatch.setattr("tersely.llm.common.give_back", lambda: given.append(1))
    near_copies.packed_sets(Rows(**TEXTS), 5)
    assert given == [1]
