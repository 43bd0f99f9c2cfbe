"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

``write_token_files`` sorts documents by id over range partitions; each task encodes
its documents in order and writes two files into a folder every executor reaches:

- ``part-N.bin``: the ids of all its documents, one after the other, little-endian
  unsigned integers of ``id_bytes`` bytes (2 where every id fits, else 4);
- ``part-N.idx``: n + 1 unsigned 64-bit offsets in ids, n signed 64-bit document ids,
  then n bytes that are 1 where the document id is null.

The only thing that comes back is a row of counts for each part. Their prefix sums are
the parts' bases, so a document's place in the whole is base + offset and no task has
to wait for another. A task writes under a name of its own attempt and renames at the
end; a repeated attempt writes the same bytes.

Null and empty texts hold the end id alone. Rows that share a document id are ordered
by text; each row of the input is a document. An empty table gives no parts.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tersely.llm.bpe import byte_letters
from tersely.llm.common import folder as scratch_folder
from tersely.llm.common import kept, lean, slices, texts_of

#: White space as the vocabularies' patterns take it (fixed value).
WHITE = "\t-\r \x85\xa0  -     　"
#: Letters and marks whose class is the same in every version of the patterns.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = r"!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~-"
#: Borders that the byte-level pattern never crosses: a word of letters with the space
#: before it, up to white space or a mark; a run of marks up to white space or a letter;
#: else everything up to white space; white space up to the last character before a word.
UNITS = re.compile(
    f" ?[{LATIN}]++(?![^{WHITE}{MARKS}])| ?[{MARKS}]++(?![^{WHITE}{LATIN}])"
    f"| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
#: Units that the pattern keeps whole, so that the merges can be asked for them directly.
ONE_PIECE = re.compile(f" ?(?:[{LATIN}]+|[{MARKS}]+)")
#: Units of one generation of a memo, some 200 bytes each.
MEMO_ENTRIES = 240_000
SLICE_BYTES = 500_000

MANIFEST = StructType(
    [StructField(name, LongType()) for name in ("part", "n_docs", "n_tokens", "base")]
)
PLACES = "doc_id long, start long, n_tokens long, ids_crc32 long"


class UnitIds(dict):
    """The ids of units as bytes; a missing unit comes from the generation before or the library."""

    def __init__(self, tokenizer, code: str, older: dict[str, bytes]):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()
        self.code, self.older = code, older

    def spelled(self, unit: str) -> str:
        """A unit as the letters that stand for its bytes."""
        if unit.isascii():
            return unit.replace(" ", self.letters[32])
        return "".join(map(self.letters.__getitem__, unit.encode()))

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None and ONE_PIECE.fullmatch(unit):
            found = array(self.code, [t.id for t in self.model.tokenize(self.spelled(unit))]).tobytes()
        elif found is None:
            found = self.whole(unit)
        self[unit] = found
        return found


class ByteEncoder:
    """The tokenizers library over whole texts, unit by unit.

    A byte-level vocabulary splits text at its pattern before any merge, so a unit's
    ids do not depend on its neighbours. Units repeat, and a memo of two generations,
    bounded, spares asking the library again for the frequent ones. Texts that hold
    the string of a special token are given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.memo = UnitIds(self.tokenizer, self.code, {})

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``kind``."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.older = {}
            self.memo = UnitIds(self.tokenizer, self.code, self.memo)
        ids = self.memo
        return [
            ids.whole(text)
            if self.added and self.added.search(text)
            else b"".join(map(ids.__getitem__, UNITS.findall(text)))
            for text in texts
        ]


_encoders: dict[str, ByteEncoder] = kept(__name__)


def encoder(path: str) -> ByteEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the files below ``folder`` and return their manifest (part, n_docs, n_tokens, base).

    ``base`` is the number of ids in all parts before. Writing happens now; the
    manifest has a row for each part, whatever the number of documents.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(vocabulary), TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/part-{task.partitionId()}"
        own = f"{root}/.{task.partitionId()}-{task.taskAttemptId()}"
        end = np.array([end_id], dtype=coder.kind).tobytes()
        lengths, ids, nulls = [], [], []
        with store.open_output_stream(f"{own}.bin") as out:
            for part in slices(batches, "text", SLICE_BYTES):
                rows = part.column(0)
                nulls.append(rows.is_null().to_numpy(zero_copy_only=False))
                ids.append(rows.fill_null(0).to_numpy(zero_copy_only=False))
                packed = [p + end for p in coder.packed(texts_of(part, "text"))]
                lengths.append(np.array([len(p) for p in packed]) // coder.kind.itemsize)
                out.write(b"".join(packed))
        n = sum(map(len, lengths))
        offsets = np.zeros(n + 1, dtype="<u8")
        if n:
            np.cumsum(np.concatenate(lengths), out=offsets[1:])
        with store.open_output_stream(f"{own}.idx") as out:
            out.write(offsets.tobytes())
            out.write(np.concatenate([np.zeros(0, "<i8"), *ids]).astype("<i8").tobytes())
            out.write(np.concatenate([np.zeros(0, bool), *nulls]).astype("u1").tobytes())
        if n:
            for end_of_name in (".bin", ".idx"):
                store.move(own + end_of_name, name + end_of_name)
            row = ([task.partitionId()], [n], [int(offsets[-1])], [0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in row], names=MANIFEST.fieldNames()
            )
        else:
            for end_of_name in (".bin", ".idx"):
                store.delete_file(own + end_of_name)

    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
    )
    parts = sorted(ordered.mapInArrow(lean(write), MANIFEST).collect())
    bases = itertools.accumulate((p.n_tokens for p in parts), initial=0)
    rows = [(p.part, p.n_docs, p.n_tokens, base) for p, base in zip(parts, bases, strict=False)]
    return spark.createDataFrame(rows, MANIFEST)


def read_token_files(manifest: DataFrame, folder: str, id_bytes: int) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32.

    Files are memory-mapped where the folder is a mounted one, else read part by part
    from the store. ``ids_crc32`` is taken over the ids as 32-bit integers.
    """

    def mapped(store: pafs.FileSystem, path: str, kind: str, first: int, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, kind)
        if isinstance(store, pafs.LocalFileSystem):
            return np.memmap(path, dtype=kind, mode="r", offset=first, shape=(n,))
        with store.open_input_file(path) as file:
            return np.frombuffer(file.read_at(n * np.dtype(kind).itemsize, first), dtype=kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                n, name = row["n_docs"], f"{root}/part-{row['part']}"
                offsets = mapped(store, f"{name}.idx", "<u8", 0, n + 1).astype(np.int64)
                ids = mapped(store, f"{name}.idx", "<i8", 8 * (n + 1), n)
                null = mapped(store, f"{name}.idx", "u1", 8 * (2 * n + 1), n) > 0
                tokens = mapped(store, f"{name}.bin", f"<u{id_bytes}", 0, row["n_tokens"])
                for at in range(0, n, 4096):
                    to = min(at + 4096, n)
                    crcs = [
                        zlib.crc32(tokens[offsets[k] : offsets[k + 1]].astype("<u4").tobytes())
                        for k in range(at, to)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(ids[at:to]), pa.int64(), mask=np.array(null[at:to])),
                            pa.array(row["base"] + offsets[at:to], pa.int64()),
                            pa.array(np.diff(offsets[at : to + 1]), pa.int64()),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A task for each part: left to its size in bytes, so small a table would be one task.
    parts = max(1, manifest.count())
    return manifest.repartitionById(parts, F.col("part").cast("int")).mapInArrow(read, PLACES)


def token_places(
    spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None
) -> DataFrame:
    """Write ``docs`` as token files and read every document's place and checksum back."""
    folder = folder or scratch_folder(spark, "token-files")
    manifest = write_token_files(docs, folder, vocabulary, end_id)
    return read_token_files(manifest, folder, encoder(vocabulary).kind.itemsize)
