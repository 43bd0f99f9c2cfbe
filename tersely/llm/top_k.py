"""Exact top-k search by columnar branch and bound.

Vectors are packed into blocks of dimension-major matrices. Blocks of queries lie in the
shared folder; a task holds some blocks of candidates and reads the queries block by
block, so no vector is shuffled. In a pair of blocks the scores are accumulated one block
of dimensions after the other. After each, Cauchy-Schwarz bounds a candidate's final score
by its partial score plus the product of the norms of what remains of query and
candidate; candidates below the query's k-th best score so far, in this block or in those
before, are dropped and the rest are compacted, so later dimensions touch ever fewer
columns. Each task gives k rows for a query and group of blocks; the k best of them all are
ranked per query, with a first cut before the shuffle.

Components are scaled and floored to integers, so scores are exact: blocks are 32-bit
floats where every component is below 2**24 in size, else 64-bit ones; products are 32-bit
floats where every partial sum is below 2**24, else 64-bit floats below 2**53, else Python
integers. Bounds are rounded up. A best score that does not fit 64 bits ends the job with an
error that names its two ids.

The queries are a stated set, which meets all rows in blocks; blocks are of fixed size,
so the number of pairs follows the work and not the memory. A third of all vectors may
be equal: they only tie, and ties go to the smaller id.

Vectors that are null or hold null or non-finite components take no part; shorter ones
count as filled up with zeros, empty ones with zeros alone. Every other row is a candidate, also rows that
repeat an id, but none with the query's own id. Equal query rows give one list. Rows without an
id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersely.llm.common import folder as scratch_folder
from tersely.llm.common import shuffles_released, written

CANDIDATES, QUERIES, DIMENSIONS, HELD = 4096, 1024, 16, 16
BLOCK = "n long, dims long, width int, ids binary, columns binary"
INT64 = 2**63


def packed(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of up to ``size`` vectors (vec_id, v), floored; a matrix holds one dimension after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(tables).combine_chunks()
            ids = whole.column(0).to_numpy().astype("<i8")
            lists = whole.column(1).combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            dims = int(lengths.max())
            matrix = np.zeros((len(ids), dims))
            matrix[np.arange(dims) < lengths[:, None]] = np.floor(lists.flatten().to_numpy() * scale)
            if not np.isfinite(matrix).all():
                first = int(np.flatnonzero(~np.isfinite(matrix).all(axis=1))[0])
                raise ValueError(f"scaled components of vector {ids[first]} are too large for 64-bit floats")
            width = 4 if np.abs(matrix).max(initial=0) < 2**24 else 8
            columns = np.ascontiguousarray(matrix.T, dtype=f"<f{width}")
            return pa.RecordBatch.from_arrays(
                [
                    *(pa.array([x], pa.int64()) for x in (len(ids), dims)),
                    pa.array([width], pa.int32()),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([columns.tobytes()], pa.binary()),
                ],
                names=["n", "dims", "width", "ids", "columns"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return vectors.mapInArrow(pack, BLOCK)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a block."""
    columns = np.frombuffer(row["columns"], f"<f{row['width']}").reshape(row["dims"], row["n"])
    return np.frombuffer(row["ids"], "<i8"), columns.astype(np.float64)


def remaining(columns: np.ndarray, step: int) -> list[np.ndarray]:
    """Norms of what is left of each vector after each block of dimensions."""
    left = [np.sqrt(np.square(columns[d:]).sum(axis=0)) for d in range(0, len(columns), step)]
    return [*left[1:], np.zeros(columns.shape[1])]


def search(
    query_ids: np.ndarray,
    queries: np.ndarray,
    ids: np.ndarray,
    columns: np.ndarray,
    k: int,
    reached: list[float] | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its best candidates, k of them or all.

    ``reached`` holds for each query a score that k candidates of other blocks reach;
    candidates below it may be left out.
    """
    dims = min(len(queries), len(columns))
    queries, columns = queries[:dims], columns[:dims]
    largest = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(columns).max(initial=0))
    most = largest * max(dims, 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    step = DIMENSIONS if kind is not object else max(dims, 1)
    if kind is object:
        whole = [[int(x) for x in c] for c in columns]
        columns = np.array(whole, dtype=object).reshape(columns.shape)
        queries = np.array([[int(x) for x in q] for q in queries], dtype=object).reshape(queries.shape)
        left = right = [np.zeros(1)]
    else:
        left, right = remaining(queries, step), remaining(columns, step)
        queries, columns = queries.astype(kind), columns.astype(kind)
    first = queries[:step].T @ columns[:step]  # the first dimensions, all queries at once
    for q in range(len(query_ids)):
        alive = np.flatnonzero(ids != query_ids[q])
        score = first[q, alive]
        for block, at in enumerate(range(0, dims, step)):
            if at:
                part = queries[at : at + step, q] @ columns[at : at + step, alive]
                score = score + part
            if kind is object or at + step >= dims or len(alive) <= k:
                continue
            rest = left[block][q] * right[block][alive] * (1 + 1e-6) + 1e-3
            # the k-th best lower bound is a score that k candidates reach
            bar = np.partition(score - rest, len(score) - k)[len(score) - k]
            bar = bar if reached is None else max(bar, reached[q])
            stay = score + rest >= bar
            alive, score = alive[stay], score[stay]
        if len(alive) > k and kind is not object:
            bar = np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[score >= bar], score[score >= bar]
        order = np.lexsort((ids[alive], -score))[:k]
        yield alive[order], score[order]


def finite(vector: Column) -> Column:
    good = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")),
    )
    return vector.isNotNull() & good


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def searched(
    asked: tuple[np.ndarray, np.ndarray], blocks: list[tuple[np.ndarray, np.ndarray]], k: int
) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Each query of a block with the ids and scores of its k best in all of ``blocks``."""
    query_ids, queries = asked
    best = [(np.zeros(0, np.int64), np.zeros(0, object))] * len(query_ids)
    reached = [-np.inf] * len(query_ids)
    for ids, columns in blocks:
        for q, (at, scores) in enumerate(search(query_ids, queries, ids, columns, k, reached)):
            exact = np.array([int(v) for v in scores], dtype=object)
            best[q] = best_of(np.append(best[q][0], ids[at]), np.append(best[q][1], exact), k)
            if len(best[q][0]) == k and abs(best[q][1][-1]) < INT64:
                # Rounded down, so that a tie is never left out.
                lowest = float(best[q][1][-1])
                reached[q] = lowest - abs(lowest) * 1e-9 - 1
    for query, (ids, scores) in zip(query_ids.tolist(), best):
        for vec_id, score in zip(ids.tolist(), scores):
            if not -INT64 <= score < INT64:
                raise ValueError(f"score of query {query} and vector {vec_id} does not fit 64 bits")
        yield query, ids, scores.tolist()


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query.

    ``queries`` is a condition on the rows of ``vectors``; ties go to the smaller id.
    """
    spark = vectors.sparkSession
    chosen = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull())
    as_doubles = F.transform(vector_col, lambda x: x.cast("double")).alias("v")
    columns = [F.col(id_col).cast("long").alias("vec_id"), as_doubles]
    candidates = written(packed(chosen.select(*columns), CANDIDATES, scale), "top-k-candidates")
    query_files = scratch_folder(spark, "top-k-queries")
    asked = packed(chosen.where(queries).select(*columns).dropDuplicates(), QUERIES, scale)
    with shuffles_released(spark):
        asked.write.parquet(query_files)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(query_files)

        def against(blocks: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            names = ["n", "dims", "width", "ids", "columns"]
            files = ds.dataset(root, filesystem=store, format="parquet")
            for batch in files.to_batches(names, batch_size=1):
                for row in batch.to_pylist():
                    asks, places, scores = [], [], []
                    for query, ids, values in searched(unpacked(row), blocks, k):
                        asks.append(np.full(len(ids), query))
                        places.append(ids)
                        scores += values
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(asks), pa.int64()),
                            pa.array(np.concatenate(places), pa.int64()),
                            pa.array(scores, pa.int64()),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(unpacked(row))
                if len(held) == HELD:
                    yield from against(held)
                    held = []
        if held:
            yield from against(held)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = candidates.mapInArrow(score, "query_id long, vec_id long, score long")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
