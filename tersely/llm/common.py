"""Helpers the operators share: tables, scratch folders, bounded slices, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.plans.inputs import scratch

SLICE_BYTES = 1_500_000
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that go to a Python worker at once, beside the usual number of rows.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_noting: list[list[str]] = []


def folder(spark: SparkSession, name: str, kept: bool = False) -> str:
    """A new scratch folder; ``temporary`` blocks delete those made inside, the innermost not ``kept`` ones."""
    path = scratch(spark, name)
    for noted in _noting[: -1 if kept else None]:
        noted.append(path)
    return path


def discard(folders: list[str]) -> None:
    """Delete scratch folders of which nothing is read any more."""
    for path in folders:
        store, root = pafs.FileSystem.from_uri(path)
        if store.get_file_info(root).type == pafs.FileType.Directory:
            store.delete_dir(root)
    folders.clear()


@contextmanager
def noted(into: list[str]) -> Iterator[list[str]]:
    """Add the scratch folders made inside to a list."""
    _noting.append(into)
    try:
        yield into
    finally:
        _noting[:] = [held for held in _noting if held is not into]


@contextmanager
def temporary() -> Iterator[None]:
    """Delete the scratch folders made inside at the end, but for tables written with ``kept``."""
    with noted([]) as made:
        try:
            yield
        finally:
            discard(made)


@contextmanager
def shuffles_released(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each has ended; Arrow batches are small.

    ``more`` are further settings, which come before these.
    """
    settings = {CLEANUP: "true"} | BATCH_BYTES | (more or {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def written(df: DataFrame, name: str, kept: bool = False, more: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder: its lineage is cut, its shuffles are gone."""
    spark = df.sparkSession
    path = folder(spark, name, kept)
    with shuffles_released(spark, more):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, the place from 0 among the rows of equal ``keys``, and ``of``, their number.

    ``keys`` hold no nulls and ``order`` holds comparable columns; nulls come first. Equal rows
    are told apart by a number of their own, so a range never holds more than its share of
    them. The sorted rows are written, so their places stay when a task is repeated; only
    one row for each key and range is summed up to find where a range begins.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_tie"]
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_rows = told.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    stored = written(sorted_rows.withColumn("_row", F.monotonically_increasing_id()), f"{name}-sorted")
    stored = stored.withColumn("_part", F.shiftright("_row", 33))
    runs = stored.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    whole = Window.partitionBy(*keys or [F.lit(0)])
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *keys,
        "_part",
        "_first",
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"),
        F.sum("_count").over(whole).alias("of"),
    )
    found = stored.join(written(runs, f"{name}-ranges"), [*keys, "_part"])
    return found.withColumn("at", F.col("_row") - F.col("_first") + F.col("_base")).drop(
        "_row", "_part", "_first", "_base"
    )


def text_key(column: str = "text"):
    """Hash of a text that, with the id, names a row; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def bucket_count(docs: DataFrame, text_col: str, bytes_each: int) -> int:
    """Buckets of about ``bytes_each`` of text, and some for every shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * parts, -(-total // bytes_each))


def slices(
    batches: Iterator[pa.RecordBatch], text_col: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text each.

    A single longer text is a slice of its own; texts are never cut.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        first, held = 0, 0
        for row, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


#: What the operators keep in a worker process for its next tasks, by module.
_kept: dict[str, dict] = {}


def kept(module: str) -> dict:
    """The store of an operator's module in this worker process; ``lean`` steps of other modules empty it."""
    return _kept.setdefault(module, {})


def drop_others(module: str) -> None:
    """Empty the stores of all modules but one."""
    for name, held in _kept.items():
        if name != module:
            held.clear()


def give_back() -> None:
    """Return freed memory, which Arrow and the C library hold on to, to the system."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def lean(step: Callable) -> Callable:
    """``step`` of a ``mapInArrow``, which leaves little behind in its worker process.

    Workers outlive their tasks and lie beside the executor's heap in its memory. A task begins
    without what other operators keep there, and at its end freed memory goes back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_others(step.__module__)
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def texts_of(batch: pa.RecordBatch, text_col: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, U64(base))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _letters(fold_case: bool) -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    if fold_case:
        codes[65:91] += U64(32)
    return mixed(codes * U64(0xD6E8FEB86659FD93) + U64(0xA0761D6478BD642F))


_LETTERS = {fold: _letters(fold) for fold in (False, True)}
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
#: Everything but ASCII letters and the bytes of other characters.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def hashed_words(
    texts: list[str], fold_case: bool, blank: np.ndarray = _BLANK
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin (one more at the end).

    Words are runs other than space and U+0009 to U+000D, or other than the bytes that
    ``blank`` marks (space must be one); ``fold_case`` lowers A-Z. The hash is a polynomial over a table of random letters, so that all words of a
    slice come from one running sum, then a finaliser.
    """
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    word = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(blank[data], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    first, last = edges[0::2], edges[1::2]
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_LETTERS[fold_case][data] * up[: len(data)], out=total[1:])
    hashes = mixed((total[last] - total[first]) * down[first])
    bounds = np.concatenate([[0], np.searchsorted(first, ends)]) if parts else np.zeros(1, np.int64)
    return hashes, bounds.astype(np.int64)


def rolling(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, U64((salt * 0x632BE59BD9B4E019 + 0x1234567) & (2**64 - 1)))
    for k in range(size):
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += hashes[k : k + n]
    return mixed(out)


def breaks(values: np.ndarray) -> np.ndarray:
    """True at the first value and wherever a value differs from the one before."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    offsets = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total, dtype=np.int64) - offsets + np.repeat(starts, lengths)
