"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

The whole corpus is the reference. It is laid out in blocks by content: each run of
``window`` words belongs to the block that its smallest seed (``SEED`` words) hashes to,
so equal runs meet in one block wherever they stand, and a document only has to be
parsed against the blocks its own runs lead to. Consecutive runs of one block travel
together as a segment.

In a block, an index maps each run to the first place where it stands; segments are taken in
document order and parsed greedily against it: a factor starts at the first run that stands
earlier, copies from that earlier place run after run as long as both sides agree, and ends
where they differ or a segment does. The run beyond a factor's border, which holds words of
both sides, is then looked up by itself, so no run that crosses a border is missed. Factors
(start, length, source, place there) go back to their documents, where those that go on in
the same source become one across segment borders.

Before the shuffle each slice of documents is parsed against itself, so a block gets
every run once from each slice, however often it occurs there; a block still gets a
common passage once from each slice that has it. Runs are compared by
64-bit hashes within blocks that an independent hash has chosen.

Order is document id (null first), then a hash of the text. Rows with equal id and text
are one document: each gets the same answer and none is a copy of the other. Null and
empty texts have no words; documents shorter than a window lose nothing. Whole texts
are parsed, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import (
    breaks,
    bucket_count,
    hashed_words,
    ragged,
    rolling,
    slices,
    texts_of,
)

SEED = 4
BLOCK_BYTES = 8_000_000
#: A longer slice finds more of its own repeats before the shuffle.
SLICE_BYTES = 6_000_000
WORD = re.compile("[^ \t-\r]+")
FIRST_ID = -(2**63)

BLOB_ROWS = "bucket long, kind int, blob binary"
SEGMENT = np.dtype([("doc", "<i8"), ("key", "<u4"), ("start", "<u4"), ("n", "<u2")])
#: ``n`` runs from ``start`` on, copied from ``place`` on in document ``of``.
FACTOR = np.dtype(
    [("doc", "<i8"), ("key", "<u4"), ("start", "<u4"), ("n", "<u4"), ("of", "<i8"), ("place", "<u4")]
)
MOST = 65_535
FACTORS = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])
)
OUT = (
    "doc_id long, n_words long, n_removed long, kept_text string, "
    "factors array<struct<start:long,length:long,source:long,source_start:long>>"
)


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every ``size`` consecutive values."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def runs_of(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs that begin where ``breaks`` is true."""
    starts = np.flatnonzero(breaks)
    return starts, np.diff(np.append(starts, len(breaks)))


def agreeing(body: np.ndarray, at: int, source: int, most: int) -> int:
    """How many runs from ``at`` and ``source`` on are equal, ``most`` at most; looks further in doubling steps."""
    have, step = 0, 32
    while have < most:
        size = min(step, most - have)
        differ = np.flatnonzero(
            body[at + have : at + have + size] != body[source + have : source + have + size]
        )
        if len(differ):
            return have + int(differ[0])
        have, step = have + size, 2 * step
    return most


def greedy(
    body: np.ndarray, leader: np.ndarray, known: np.ndarray, stretch: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and source start of the factors of all known runs.

    ``leader`` is the first place of each run; neither a factor nor its source leaves its
    ``stretch`` (numbers that rise along ``body``).
    """
    at = np.flatnonzero(known)
    if not len(at):
        return at, at, at
    starts, lengths = runs_of(breaks(stretch[at]) | np.append(True, np.diff(at) != 1))
    # Where the leaders of a row of known runs follow each other, the row is one factor.
    follows = (np.diff(leader[at]) == 1) & (np.diff(stretch[leader[at]]) == 0)
    jumps = np.append(0, np.cumsum(np.append(~follows, True)))
    split = jumps[starts + lengths - 1] != jumps[starts]
    begins, sizes, sources = at[starts[~split]], lengths[~split], leader[at[starts[~split]]]
    ends = np.append(np.flatnonzero(np.diff(stretch)) + 1, len(body))
    more = []
    for first, n in zip(at[starts[split]].tolist(), lengths[split].tolist(), strict=True):
        place, last = first, first + n
        while place < last:
            source = int(leader[place])
            room = int(ends[np.searchsorted(ends, source, side="right")]) - source
            size = agreeing(body, place, source, min(last - place, room))
            more.append((place, size, source))
            place += size
    if more:
        extra = np.array(more, dtype=np.int64).T
        begins, sizes, sources = (np.append(x, y) for x, y in zip((begins, sizes, sources), extra, strict=True))
    return begins, sizes, sources


def doc_bucket(spans: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(spans["doc"] ^ spans["key"].astype(np.int64), buckets)


def grouped(rows: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """A blob of rows for each bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    starts, lengths = runs_of(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    for s, n in zip(starts, lengths, strict=True):
        yield int(bucket[s]), kind, rows[s : s + n].tobytes()


def segments(
    docs: np.ndarray, keys: np.ndarray, texts: list[str], window: int, blocks: int
) -> Iterator[tuple[int, int, bytes]]:
    """Segments for each block, and the spans that occur earlier in this slice.

    Documents come ordered by (id, key), each of them once.
    """
    words, bounds = hashed_words(texts, fold_case=False)
    total = max(0, len(words) - window + 1)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    inside = doc_of[:total] == doc_of[window - 1 : window - 1 + total]
    at = np.flatnonzero(inside)
    if not len(at):
        return
    run = rolling(words, window)[at]
    seeds = smallest(rolling(words, SEED, salt=1), window - SEED + 1)[at]
    block = (seeds % np.uint64(blocks)).astype(np.int64)
    owner = doc_of[at]
    place = at - bounds[owner]

    _, index, inverse = np.unique(run, return_index=True, return_inverse=True)
    leader = index[inverse]
    first = leader == np.arange(len(run))
    begins, n, sources = greedy(run, leader, ~first, owner)
    if len(begins):
        yield from grouped(factors_at(docs, keys, owner, place, begins, n, sources), block[begins], 1)
    own = np.flatnonzero(first)
    starts, n = runs_of(
        np.append(True, np.diff(at[own]) != 1) | breaks(owner[own]) | breaks(block[own])
    )
    extra = (n - 1) // MOST  # very long segments are cut, so that lengths fit
    if extra.any():
        more = ragged(np.zeros(len(n), np.int64), extra + 1)
        starts = np.repeat(starts, extra + 1) + more * MOST
        n = np.minimum(np.repeat(n, extra + 1) - more * MOST, MOST)
    spans = np.zeros(len(n), dtype=SEGMENT)
    spans["doc"], spans["key"] = docs[owner[own[starts]]], keys[owner[own[starts]]]
    spans["start"], spans["n"] = place[own[starts]], n
    goes = block[own[starts]]
    order = np.argsort(goes, kind="stable")
    spans, goes, starts, n = spans[order], goes[order], starts[order], n[order]
    hashes = run[own][ragged(starts, n)]
    ends = np.append(0, np.cumsum(n))
    groups, sizes = runs_of(breaks(goes))
    for g, size in zip(groups, sizes, strict=True):
        head = np.array([size], dtype="<u4").tobytes()
        body = hashes[ends[g] : ends[g + size]].tobytes()
        yield int(goes[g]), 0, head + spans[g : g + size].tobytes() + body


def factors_at(docs, keys, owner, place, begins, n, sources) -> np.ndarray:
    """Rows of factors from positions in an array of runs, ``owner`` and ``place`` of each."""
    out = np.zeros(len(begins), dtype=FACTOR)
    out["doc"], out["key"] = docs[owner[begins]], keys[owner[begins]]
    out["start"], out["n"] = place[begins], n
    out["of"], out["place"] = docs[owner[sources]], place[sources]
    return out


def whole_factors(factors: np.ndarray) -> np.ndarray:
    """Factors in order, those that go on in the same source joined."""
    rows = factors[np.lexsort((factors["start"], factors["key"], factors["doc"]))]
    if not len(rows):
        return rows
    before, after = rows[:-1], rows[1:]
    shift = lambda r: r["start"].astype(np.int64) - r["place"]
    goes_on = after["start"] == before["start"] + before["n"]
    for same in ((after[c] == before[c]) for c in ("doc", "key", "of")):
        goes_on &= same
    goes_on &= shift(after) == shift(before)
    heads = np.flatnonzero(np.append(True, ~goes_on))
    out = rows[heads]
    out["n"] = np.add.reduceat(rows["n"], heads)
    return out


def parsed(blobs: list[bytes]) -> np.ndarray:
    """The factors of a block's segments against its earlier ones."""
    heads, bodies = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        heads.append(np.frombuffer(blob, SEGMENT, n, 4))
        bodies.append(np.frombuffer(blob, "<u8", offset=4 + n * SEGMENT.itemsize))
    head, body = np.concatenate(heads), np.concatenate(bodies)
    n = head["n"].astype(np.int64)
    begins = np.cumsum(n) - n
    order = np.lexsort((head["start"], head["key"], head["doc"]))
    head, n = head[order], n[order]
    body = body[ragged(begins[order], n)]
    segment = np.repeat(np.arange(len(head)), n)
    place = head["start"][segment] + ragged(np.zeros(len(n), np.int64), n)

    by_hash = np.argsort(body, kind="stable")  # occurrences of a run stay in document order
    group = np.cumsum(breaks(body[by_hash])) - 1
    leader = by_hash[np.flatnonzero(breaks(body[by_hash]))][group]
    same = (
        (head["doc"][segment[leader]] == head["doc"][segment[by_hash]])
        & (head["key"][segment[leader]] == head["key"][segment[by_hash]])
        & (place[leader] == place[by_hash])
    )
    known, first = np.zeros(len(body), dtype=bool), np.zeros(len(body), dtype=np.int64)
    known[by_hash], first[by_hash] = ~same, leader
    begins, sizes, sources = greedy(body, first, known, segment)
    return factors_at(head["doc"], head["key"], segment, place, begins, sizes, sources)


def listed_factors(own: np.ndarray, window: int) -> list[dict]:
    """Factors as they are given out, in words."""
    columns = (own[c].tolist() for c in ("start", "n", "of", "place"))
    return [
        {"start": a, "length": n + window - 1, "source": None if of == FIRST_ID else of, "source_start": b}
        for a, n, of, b in zip(*columns, strict=True)
    ]


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, kinds, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())],
        names=["bucket", "kind", "blob"],
    )


def batched(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 4_000_000:
            yield blob_batch(held)
            held, size = [], 0
    if held:
        yield blob_batch(held)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_text and factors.

    A word goes if a window of ``window`` words around it also starts earlier: in a
    document of smaller id, or before in its own. ``kept_text`` holds the other words
    joined by single spaces. ``factors`` lists what was copied: start, length (in words, ``window``
    at least), source (a document) and source_start.
    """
    if window < SEED:
        raise ValueError(f"window must be {SEED} words or more")
    blocks = bucket_count(docs, text_col, BLOCK_BYTES)
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).withColumn("key", F.shiftrightunsigned(F.xxhash64("text"), 32))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            doc = part.column(0).fill_null(FIRST_ID).to_numpy(zero_copy_only=False)
            key = part.column(2).to_numpy(zero_copy_only=False).astype(np.uint32)
            order = np.lexsort((key, doc))
            once = order[breaks(doc[order]) | breaks(key[order])]
            texts = texts_of(part, "text")
            found = segments(doc[once], key[once], [texts[i] for i in once], window, blocks)
            yield from batched(found)

    def parse(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_pylist()
        blobs = group.column("blob").to_pylist()
        mine = [blob for kind, blob in zip(kinds, blobs, strict=True) if kind == 0]
        spans = [np.frombuffer(b, FACTOR) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        spans += [parsed(mine)] if mine else []
        every = np.concatenate(spans)
        if not len(every):
            return pa.Table.from_batches([], blob_batch([(0, 0, b"")]).schema)
        return pa.Table.from_batches([blob_batch(list(grouped(every, doc_bucket(every, blocks), 1)))])

    def take_out(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = right.column("blob").to_pylist()
        spans = np.concatenate([np.zeros(0, FACTOR), *(np.frombuffer(b, FACTOR) for b in blobs)])
        spans = whole_factors(spans)
        starts, n = runs_of(breaks(spans["doc"]) | breaks(spans["key"]))
        of = {
            (int(spans["doc"][s]), int(spans["key"][s])): spans[s : s + k]
            for s, k in zip(starts, n, strict=True)
        }
        ids = left.column("doc_id").to_pylist()
        out = {"n_words": [], "n_removed": [], "kept_text": [], "factors": []}
        for doc, key, text in zip(
            ids, left.column("key").to_pylist(), left.column("text").to_pylist(), strict=True
        ):
            words = WORD.findall(text or "")
            own = of.get((FIRST_ID if doc is None else doc, key))
            kept = words
            if own is not None:
                steps = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(steps, own["start"].astype(np.int64), 1)
                np.add.at(steps, own["start"].astype(np.int64) + own["n"] + window - 1, -1)
                kept = list(compress(words, (np.cumsum(steps)[:-1] == 0).tolist()))
            out["factors"].append([] if own is None else listed_factors(own, window))
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_text"].append(" ".join(kept))
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_words": pa.array(out["n_words"], pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "kept_text": pa.array(out["kept_text"], pa.string()),
                "factors": pa.array(out["factors"], FACTORS),
            }
        )

    spans = (
        keyed.mapInArrow(to_blocks, BLOB_ROWS)
        .groupBy("bucket")
        .applyInArrow(parse, BLOB_ROWS)
    )
    home = F.pmod(F.coalesce("doc_id", F.lit(FIRST_ID)).bitwiseXOR(F.col("key")), F.lit(blocks))
    homes = keyed.withColumn("bucket", home)
    return (
        homes.groupBy("bucket")
        .cogroup(spans.groupBy("bucket"))
        .applyInArrow(take_out, OUT)
    )
