"""Chunked compaction of arriving documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tersely.functions import text as T
from tersely.functions.blocks import classify
from tersely.operators.compact import Options, compact_documents
from tersely.sources.snapshots import update_snapshot

# --- fixed values -----------------------------------------------------------
CHUNK_SIZE = 8192
# ----------------------------------------------------------------------------


def chunk_documents(
    documents: DataFrame, size: int = CHUNK_SIZE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per chunk: id, ``chunk_no`` (0-based), ``chunk``. Batch or stream."""
    return documents.select(
        id_col, F.posexplode(T.chunks(F.col(text_col), size)).alias("chunk_no", "chunk")
    )


def compact_chunks(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
    options: Options | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Compact every chunk as a document of its own; ``keep`` names columns each chunk takes along."""
    cut = F.posexplode(T.chunks(F.col(text_col), size)).alias("chunk_no", "chunk")
    chunks = documents.select(id_col, *keep, cut)
    keyed = chunks.select(
        F.concat_ws("/", F.col(id_col).cast("string"), F.col("chunk_no").cast("string")).alias(
            "chunk_id"
        ),
        F.col(id_col),
        "chunk_no",
        *keep,
        F.col("chunk").alias("text"),
    )
    return compact_documents(keyed, "chunk_id", "text", options)


def stream_compact(
    documents: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    size: int = CHUNK_SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
    options: Options | None = None,
    keep: Sequence[str] = (),
) -> StreamingQuery:
    """Compact a stream of documents chunk by chunk.

    Each micro-batch is compacted as a batch, since windows over rows are not
    available on streams. ``write(results, batch_id)`` must be idempotent per
    batch id: a batch is repeated after a failure.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write(compact_chunks(batch, size, id_col, text_col, options, keep), batch_id)

    return (
        documents.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def record_chunks(
    documents: DataFrame,
    folder: str,
    tool: Column,
    ts: Column,
    size: int = CHUNK_SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
    options: Options | None = None,
) -> StreamingQuery:
    """Compact a stream chunk by chunk, record each chunk, and count it in running metrics.

    Below ``folder`` lie ``chunks`` (a record for each chunk, one folder a micro-batch), ``metrics``
    (the snapshot) and ``checkpoint``. A chunk counts once: its records replace those of a
    failed attempt at the same batch, and the snapshot knows the last batch in it. Chunks are
    compacted once; the counters are taken from the records.
    """

    def record(chunks: DataFrame, batch_id: int) -> None:
        path = f"{folder}/chunks/batch={batch_id}"
        names = ("output", "transformed", "action", "reason", "input_tokens", "output_tokens")
        chunks.select(id_col, "chunk_no", "tool", "ts", *names).write.mode("overwrite").parquet(path)
        update_snapshot(chunks.sparkSession.read.parquet(path), f"{folder}/metrics", batch_id)

    named = documents.select(id_col, text_col, tool.alias("tool"), ts.alias("ts"))
    return stream_compact(
        named, record, f"{folder}/checkpoint", size, id_col, text_col, options, ("tool", "ts")
    )


def live_columns(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Type, estimate, size and redacted hash of each document; batch or stream."""
    text = F.col(text_col)
    return documents.select(
        "*",
        classify(text).alias("kind"),
        T.estimate_tokens(text).alias("tokens"),
        T.input_bytes(text).alias("bytes"),
        T.audit_hash(text).alias("input_hash"),
    )
