"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is a word, a pair of neighbours, or a pair with one word between (the skip-gram),
hashed into ``DIMENSIONS`` coordinates; a text has a feature or has it not. Words are runs of
ASCII letters and characters beyond ASCII, A-Z lower-cased. FTRL-proximal keeps two sums for
each coordinate: z, from which the weight follows in closed form and is exactly 0 while
|z| <= L1, and n, the squared gradients, which give the coordinate its own rate.

Training is rounds over shards of a sample: every shard starts from the common sums, passes
its rows once in the order of their hashes, and the sums of all shards are averaged for the
next round. A shard is a stream of rows, so a task holds the sums and one slice of text. What
is left after the last round, the weights that are not 0, is small and is broadcast to score
all documents; until then the sums lie in the shared folder and not on the driver. A line fitted to margins of sample rows that no shard has seen (Platt's
method) turns margins into probabilities.

The sample holds ``train_docs`` labelled documents on average, those with the smallest hashes;
its bound does not grow with the tables. Scores use nothing but the text.

* Null and empty texts, and texts without a word, have the bias alone and get its score.
* A row of ``labels`` without id or label, or with a label other than 0 and 1, is ignored; an id
  with both labels counts as 1. Documents without an id are scored, never learnt from, and not
  held out. Repeated rows are learnt from once and scored each; ids may repeat.
* Without labelled documents every score is 0.0. An empty table gives an empty one.
* Columns of ``docs`` other than the two named are not looked at and do not come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import (
    NOT_LETTERS,
    U64,
    hashed_words,
    mixed,
    shuffles_released,
    slices,
    temporary,
    text_key,
    texts_of,
    written,
)
from tersely.llm.common import folder as scratch_folder

BITS = 20
DIMENSIONS = 1 << BITS
BIAS = DIMENSIONS  # one coordinate more, that every text has
GAPS = (1, 2)  # neighbours and pairs with one word between
SHARDS, ROUNDS, TRAIN_DOCS = 4, 4, 16_384
CALIBRATION = 8  # one sample row in eight only sets the line from margin to probability
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.1
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """The coordinates whose weights are not 0, and margin to probability."""

    places: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids that labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and coordinates of all texts, each pair once, sorted; the bias included.

    With ``wanted`` (a flag for each coordinate) only coordinates that it marks.
    """
    words, bounds = hashed_words(texts, True, NOT_LETTERS)
    rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
    found = [rows * (DIMENSIONS + 1) + (words >> U64(64 - BITS)).astype(np.int64)]
    for gap in GAPS:
        inside = rows[:-gap] == rows[gap:]
        pairs = mixed(words[:-gap] * U64(0x9E3779B97F4A7C15) + words[gap:] * U64(2 * gap + 1))
        places = (pairs >> U64(64 - BITS)).astype(np.int64)
        found.append((rows[:-gap] * (DIMENSIONS + 1) + places)[inside])
    both = np.concatenate(found)
    if wanted is not None:
        both = both[wanted[both % (DIMENSIONS + 1)]]
    both = np.unique(np.concatenate([both, np.arange(len(texts)) * (DIMENSIONS + 1) + BIAS]))
    return both // (DIMENSIONS + 1), both % (DIMENSIONS + 1)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The FTRL-proximal weights of the sums of gradients."""
    rate = (BETA + np.sqrt(n)) / ALPHA + L2
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / rate)


def learn(z: np.ndarray, n: np.ndarray, places: np.ndarray, label: int) -> None:
    """One step of FTRL-proximal on one text, in place."""
    here, seen = z[places], n[places]
    weight = weights_of(here, seen)
    error = 1 / (1 + np.exp(-np.clip(weight.sum(), -35, 35))) - label
    more = seen + error * error
    z[places] = here + error - (np.sqrt(more) - np.sqrt(seen)) / ALPHA * weight
    n[places] = more


def sample(docs: DataFrame, labels: DataFrame, train_docs: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text, toxic, shard and place of the labelled documents that are learnt from.

    Rows are picked by hashes of id and text below a bound that follows from their number.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    rows = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"))
    labelled = rows.distinct().join(known, "_id").withColumn("_place", F.xxhash64("_id", "_key"))
    total = labelled.count()
    if total > train_docs:
        bound = int(2.0**64 * train_docs / total) - 2**63
        labelled = labelled.where(F.col("_place") < bound)
    # Expected rows are train_docs at most, of four numbers each: small enough to broadcast.
    texts = docs.select(
        F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).alias("_text")
    )
    found = texts.join(F.broadcast(labelled), ["_id", "_key"])
    found = found.groupBy("_id", "_key").agg(
        F.first("_toxic").alias("toxic"), F.first("_place").alias("place"), F.first("_text").alias("text")
    )
    shard = F.pmod(F.xxhash64("place"), F.lit(SHARDS * CALIBRATION))
    return found.select(
        "text",
        "toxic",
        F.when(shard < SHARDS, -1).otherwise(shard % SHARDS).cast("int").alias("shard"),
        "place",
    )


def stored_sums(folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """z and n, averaged over the shards that wrote to ``folder``; zeros without one."""
    sums = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    if folder is None:
        return sums
    store, root = pafs.FileSystem.from_uri(folder)
    table = ds.dataset(root, filesystem=store, format="parquet").to_table(["shard", "z", "n"])
    for row in table.sort_by("shard").to_pylist():
        for total, name in zip(sums, "zn"):
            total += np.frombuffer(row[name], "<f4")
    return sums[0] / table.num_rows, sums[1] / table.num_rows


def one_round(rows: DataFrame, folder: str | None) -> str:
    """Folder of the sums of every shard after it has passed its rows once, from those of ``folder``."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def state(shard: int, *sums: np.ndarray) -> pa.RecordBatch:
            packed = [pa.array([a.astype("<f4").tobytes()], pa.binary()) for a in sums]
            return pa.RecordBatch.from_arrays([pa.array([shard]), *packed], names=["shard", "z", "n"])

        at, z, n = None, None, None
        for batch in slices(batches, "text"):
            numbers, toxic = batch.column("shard").to_pylist(), batch.column("toxic").to_pylist()
            rows, places = features(texts_of(batch, "text"))
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            for i, shard in enumerate(numbers):
                if shard != at:
                    if at is not None:
                        yield state(at, z, n)
                    at, (z, n) = shard, stored_sums(folder)
                learn(z, n, places[bounds[i] : bounds[i + 1]], toxic[i])
        if at is not None:
            yield state(at, z, n)

    dealt = rows.where("shard >= 0").repartitionById(SHARDS, F.col("shard")).sortWithinPartitions("shard", "place")
    out = scratch_folder(rows.sparkSession, "toxicity-sums")
    with shuffles_released(rows.sparkSession):
        dealt.mapInArrow(passed, "shard long, z binary, n binary").write.parquet(out)
    return out


def learnt(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not 0 after all rounds over ``rows``."""
    folder = None
    for _ in range(ROUNDS):
        folder = one_round(rows, folder)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            weight = weights_of(*stored_sums(folder))
            places = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(weight[places])], names=["place", "weight"])

    one = rows.sparkSession.range(1, numPartitions=1)
    found = one.mapInArrow(weights, "place long, weight double").toArrow().sort_by("place")
    return found["place"].to_numpy().astype(np.int32), found["weight"].to_numpy()


def margins(rows: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` and the margin of each row's ``text``."""
    weights = rows.sparkSession.sparkContext.broadcast((model.places, model.weights))
    schema = rows.select(*keep, F.lit(0.0).alias("margin")).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(DIMENSIONS + 1)
        places, values = weights.value
        dense[places] = values
        wanted = dense != 0
        for batch in slices(batches, "text"):
            at, found = features(texts_of(batch, "text"), wanted)
            margin = np.bincount(at, weights=dense[found], minlength=batch.num_rows)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(margin)], names=[*keep, "margin"])

    return rows.select(*keep, "text").mapInArrow(judge, schema)


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic line through margins; the targets are drawn in a little."""
    ones = int(label.sum())
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -35, 35)))
        v = p * (1 - p) + 1e-9
        down = np.array([((p - target) * margin).sum() + 0.1 * (slope - 1), (p - target).sum() + 1e-3 * shift])
        curve = np.array(
            [[(v * margin**2).sum() + 0.1, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]]
        )
        step = np.linalg.solve(curve, down)
        slope, shift = max(slope - step[0], 1e-3), shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(shift)


def train(
    docs: DataFrame,
    labels: DataFrame,
    train_docs: int = TRAIN_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model | None:
    """The weights learnt from a bounded sample of labelled documents; None without any.

    The sums stay in the shared folder; the driver gets the weights that are not 0 and a
    number for each calibration row, both bounded by constants.
    """
    with temporary():
        rows = written(sample(docs, labels, train_docs, id_col, text_col, label_col), "toxicity-sample")
        if rows.isEmpty():
            return None
        places, weights = np.zeros(0, np.int32), np.zeros(0)
        if not rows.where("shard >= 0").isEmpty():
            places, weights = learnt(rows)
        model = Model(places, weights, 1.0, 0.0)
        unseen = margins(rows.where("shard < 0"), ["toxic", "place"], model).collect()
    unseen.sort(key=lambda r: r.place)
    slope, shift = platt(np.array([r.margin for r in unseen]), np.array([r.toxic for r in unseen]))
    return Model(places, weights, slope, shift)


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        line = F.col("margin") * model.slope + model.shift
        scored = margins(rows, ["doc_id"], model).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
