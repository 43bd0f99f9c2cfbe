"""Near-duplicates by min-max hashing, with exact confirmation of links.

Each permutation of the shingles gives two signature values, its minimum and its
maximum, so ``VALUES`` values cost half as many hash evaluations. Bands of ``ROWS``
values are bucket keys; a pair at the limit of similarity 0.8 misses every band with
probability (1 - 0.8 ** ROWS) ** (VALUES / ROWS), below 1e-7.

Texts with equal shingle sets form a class and one document stands for it. Buckets are
not expanded into pairs. In every round each class is compared with a few hubs of the
buckets it is in, and the links found give components; rounds go on while they find
links. After that, all classes of one bucket that are still in different components are
compared by sketches of a byte for each value, in blocks of the bucket; pairs that could
be links come out. A link inside a component changes nothing, so none is lost. Links
are confirmed on full sets.

Words are runs other than space and U+0009 to U+000D with A-Z lowered. Texts of fewer
words than a shingle are one shingle; null texts and texts without words have none and
are linked with nothing. Shingles are compared by 64-bit hash. A document id stands for
one node: rows that share it share its component. Rows without an id take part under a
number made from their text; their component is the smallest id in it, null if there is
none, and then one of its texts is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tersely.llm.common import (
    U64,
    breaks,
    hashed_words,
    lean,
    mixed,
    ragged,
    rolling,
    shuffles_released,
    slices,
    temporary,
    text_key,
    texts_of,
    written,
)
from tersely.llm.components import components

VALUES, ROWS = 128, 4
HUBS, ROUNDS, FEW = 3, 8, 0.02
#: Sketches of a pair at similarity 0.8 agree in 102 bytes on average, in fewer than 76
#: with a probability below 1e-8.
LEAST, BLOCK, PAIRS = 76, 1024, 32_768
#: Bytes of text hashed at once; a worker holds some 25 times as much meanwhile.
SLICE_BYTES = 400_000
#: Batches of whole texts and sets: bytes to a Python worker, rows from Parquet's reader.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
PERMUTATIONS = VALUES // 2
_seeds = mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U64) * U64(0xD1342543DE82EF95))
TIMES, PLUS = _seeds[:PERMUTATIONS] | U64(1), _seeds[PERMUTATIONS:]

FEATURES = (
    "doc_id long, doc_key long, has_id boolean, n_shingles long, set1 long, set2 long, "
    "bands array<long>, sketch binary"
)


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and their borders."""
    words, bounds = hashed_words(texts, fold_case=True)
    full = rolling(words, size)
    short = {n: rolling(words, n, salt=n) for n in range(1, size)}
    sets = []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        n = end - start
        if n >= size:
            sets.append(np.unique(full[start : end - size + 1]))
        else:
            sets.append(short[n][start : start + 1] if n else full[:0])
    return np.concatenate([full[:0], *sets]), np.append(0, np.cumsum([len(s) for s in sets]))


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``VALUES`` values for each set that begins at ``starts``; no set is empty."""
    values = np.empty((VALUES, len(starts)), dtype=U64)
    for k in range(PERMUTATIONS):
        hashed = shingles * TIMES[k] + PLUS[k]
        values[2 * k] = np.minimum.reduceat(hashed, starts)
        values[2 * k + 1] = np.maximum.reduceat(hashed, starts)
    return mixed(values.T.copy())


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.empty((len(values), VALUES // ROWS), dtype=U64)
    for band in range(VALUES // ROWS):
        key = np.full(len(values), U64(band + 1))
        for row in range(band * ROWS, (band + 1) * ROWS):
            key = mixed(key * U64(0x9FB21C651E98DF25) + values[:, row])
        keys[:, band] = key
    return keys


def features(docs: DataFrame, shingle: int) -> DataFrame:
    """Set size, set digest and band keys of each row; null digests for empty sets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            shingles, bounds = shingle_sets(texts_of(part, "text"), shingle)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            starts = bounds[some]
            digests = np.zeros((2, len(sizes)), dtype=U64)
            keys = np.zeros((0, VALUES // ROWS), dtype=U64)
            sketches = np.full(len(sizes), None)
            if len(some):
                digests[0, some] = np.add.reduceat(mixed(shingles), starts)
                digests[1, some] = np.add.reduceat(mixed(shingles ^ U64(0x5851F42D4C957F2D)), starts)
                values = signatures(shingles, starts)
                keys = band_keys(values)
                sketches[some] = [row.tobytes() for row in values.astype(np.uint8)]
            none = sizes == 0
            ends = np.append(0, np.cumsum(np.where(none, 0, VALUES // ROWS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    part.column(2),
                    pa.array(sizes, pa.int64()),
                    *(pa.array(d.view(np.int64), mask=none) for d in digests),
                    bands,
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "doc_key", "has_id", "n_shingles", "set1", "set2", "bands", "sketch"],
            )

    return docs.mapInArrow(lean(make), FEATURES)


def packed_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and its shingle set as bytes of sorted 64-bit hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            shingles, bounds = shingle_sets(texts_of(part, "text"), shingle)
            sets = [shingles[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"]
            )

    return docs.mapInArrow(lean(make), "doc_id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sets share ``percent`` of their union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(left[i].as_buffer(), U64)
                y = np.frombuffer(right[i].as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                if len(x) and 100 * len(x) >= percent * len(y):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    shared = int((y[at] == x).sum())
                    keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")), "b")
    with_a = with_b.join(
        sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), "a"
    )
    return with_a.select("a", "b", "of_a", "of_b").mapInArrow(lean(check), "a long, b long")


def labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """band, class_id, n_shingles and label of the members of shared buckets."""
    if labels is None:
        return shared.withColumn("label", F.col("class_id"))
    return shared.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "band", "class_id", "n_shingles", F.coalesce("label", "class_id").alias("label")
    )


def alike(x: str, y: str, percent: int):
    """Set sizes that allow a link."""
    return F.expr(
        f"{x}.n_shingles * 100 >= {y}.n_shingles * {percent} "
        f"AND {y}.n_shingles * 100 >= {x}.n_shingles * {percent}"
    )


def hub_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs a < b of each class with the hubs, of other labels, that it meets most often.

    A bucket's hub is its smallest member in the first round, then one drawn by hash.
    """
    rank = F.col("class_id") if turn == 0 else F.xxhash64("class_id", F.lit(turn))
    hubs = (
        members.groupBy("band")
        .agg(
            F.min(F.struct(rank.alias("rank"), "class_id", "label", "n_shingles")).alias("hub"),
            F.min("label").alias("low"),
            F.max("label").alias("high"),
        )
        .where("low < high")
        .select("band", "hub")
    )
    met = (
        members.alias("own").join(hubs, "band")
        .where((F.col("own.label") != F.col("hub.label")) & alike("own", "hub", percent))
        .groupBy("class_id", F.col("hub.class_id").alias("hub"))
        .count()
    )
    often = Window.partitionBy("class_id").orderBy(F.desc("count"), "hub")
    return (
        met.withColumn("at", F.row_number().over(often))
        .where(F.col("at") <= HUBS)
        .select(F.least("class_id", "hub").alias("a"), F.greatest("class_id", "hub").alias("b"))
        .distinct()
    )


def apart(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs a < b that share a bucket but no label, and of which ``LEAST`` sketch bytes agree.

    Buckets are cut into blocks of about ``BLOCK`` members, and two blocks are compared
    inside a task. Pairs that pass come out packed, each once, by the cell of their
    homes: classes with the same smallest neighbour share homes of about ``BLOCK``
    classes.
    """
    several = (
        members.groupBy("band")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
        .where("low < high")
        .select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = (
        members.join(several, "band")
        .select("band", "class_id", "label", block.alias("block"), F.explode(others).alias("other"))
        .select(
            F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
            (F.col("block") > F.col("other")).alias("second"),
            (F.col("block") == F.col("other")).alias("alone"),
            "class_id",
            "label",
        )
    )
    spark = members.sparkSession
    groups = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("cell").to_numpy(), kind="stable")
        cell, ids, labels, blocks = (
            group.column(c).to_numpy()[order] for c in ("cell", "class_id", "label", "home")
        )
        second, alone = (group.column(c).to_numpy()[order] for c in ("second", "alone"))
        blobs = group.column("sketch").combine_chunks().take(pa.array(order))
        data = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(len(ids), VALUES)
        starts = np.flatnonzero(breaks(cell))
        ends = np.append(starts[1:], len(cell))
        last = np.repeat(ends, ends - starts)
        found: list[np.ndarray] = []
        here = np.arange(len(ids))
        after = last - here - 1  # rows of the cell that stand behind each row
        cuts = np.searchsorted(np.cumsum(after), np.arange(0, after.sum() + PAIRS, PAIRS))
        for first, stop in zip(cuts[:-1], np.minimum(cuts[1:], len(ids) - 1) + 1, strict=True):
            rows = here[first:stop]
            x = np.repeat(rows, after[rows])
            y = ragged(rows + 1, after[rows])
            met = (labels[x] != labels[y]) & (alone[x] | (second[x] != second[y]))
            x, y = x[met], y[met]
            for at in range(0, len(x), PAIRS):
                p, q = x[at : at + PAIRS], y[at : at + PAIRS]
                near = (data[p] == data[q]).sum(axis=1) >= LEAST
                p, q = p[near], q[near]
                p, q = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
                low, high = np.minimum(blocks[p], blocks[q]), np.maximum(blocks[p], blocks[q])
                home = mixed(low.view(U64) * U64(0x9E3779B97F4A7C15) + high.view(U64)).view(np.int64)
                found.append(np.stack([home, ids[p], ids[q]]))
        pairs = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
        pairs = np.unique(pairs, axis=1)
        cuts = np.flatnonzero(breaks(pairs[0]))
        homes = pairs[0, cuts]
        blobs = [part.tobytes() for part in np.split(pairs[1:].T, cuts[1:])] if len(cuts) else []
        return pa.table({"cell": pa.array(homes), "pairs": pa.array(blobs, pa.binary())})

    def merged(group: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(blob, np.int64).reshape(-1, 2) for blob in group.column("pairs").to_pylist()]
        pairs = np.unique(np.concatenate(blobs), axis=0)
        return pa.table({"cell": group.column("cell")[:1], "pairs": pa.array([pairs.tobytes()], pa.binary())})

    found = (
        placed.join(sketches, "class_id")
        .withColumn("group", F.pmod("cell", F.lit(groups)))
        .groupBy("group")
        .applyInArrow(compare, "cell long, pairs binary")
    )
    return found.groupBy("cell").applyInArrow(merged, "cell long, pairs binary")


def homes(shared: DataFrame) -> DataFrame:
    """class_id and its home: a block of the classes that have the same smallest neighbour."""
    nearest = shared.groupBy("class_id").agg(F.min("low").alias("nearest"))
    blocks = nearest.groupBy("nearest").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks"))
    return nearest.join(blocks, "nearest").select(
        "class_id", F.xxhash64("nearest", block).alias("home")
    )


def confirmed_in_cells(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among the packed pairs of ``apart``; a cell gets each of its sets once."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.unique(np.frombuffer(row["pairs"], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), row["cell"])), pa.array(ids)], names=["cell", "doc_id"]
                )

    def check(pairs: pa.Table, own: pa.Table) -> pa.Table:
        of: dict[int, list[np.ndarray]] = {}
        for doc, blob in zip(
            own.column("doc_id").to_pylist(), own.column("shingles").to_pylist(), strict=True
        ):
            of.setdefault(doc, []).append(np.frombuffer(blob, U64))
        blobs = [np.frombuffer(blob, np.int64).reshape(-1, 2) for blob in pairs.column("pairs").to_pylist()]
        rows = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *blobs]), axis=0)
        starts = np.flatnonzero(breaks(rows[:, 0]))
        links = []
        for group in np.split(rows, starts[1:]) if len(rows) else []:
            a = int(group[0, 0])
            partners = [(int(b), s) for b in group[:, 1] for s in of.get(int(b), ()) if len(s)]
            sizes = np.array([len(s) for _, s in partners])
            for own_set in of.get(a, ()):
                if not len(partners) or not len(own_set):
                    continue
                every = np.concatenate([s for _, s in partners])
                at = np.minimum(np.searchsorted(own_set, every), len(own_set) - 1)
                both = np.add.reduceat((own_set[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
                near = 100 * both >= percent * (len(own_set) + sizes - both)
                links += [(a, partners[k][0]) for k in np.flatnonzero(near)]
        return pa.table(
            {
                "a": pa.array([a for a, _ in links], pa.int64()),
                "b": pa.array([b for _, b in links], pa.int64()),
            }
        )

    needed = cells.mapInArrow(lean(members), "cell long, doc_id long").join(sets, "doc_id")
    return (
        cells.groupBy("cell").cogroup(needed.groupBy("cell")).applyInArrow(check, "a long, b long")
    )


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Per row of ``docs``: doc_id, doc_key, n_shingles, component_id and kept.

    Texts are linked if their shingle sets share ``percent`` of their union;
    ``component_id`` is the smallest id reachable and ``kept`` marks that document.
    """
    own_id, doc_key = F.col(id_col).cast("long"), text_key(text_col)
    narrow = docs.select(
        # Rows without an id take part under a number made from their text.
        F.coalesce(own_id, doc_key).alias("doc_id"),
        doc_key.alias("doc_key"),
        own_id.isNotNull().alias("has_id"),
        F.col(text_col).alias("text"),
    )
    made = written(features(narrow, shingle), "near-features", more=SMALL_BATCHES)
    filled = made.where("n_shingles > 0")
    classes = filled.groupBy("set1", "set2", "n_shingles").agg(
        F.min("doc_id").alias("class_id"),
        F.min(F.when(F.col("has_id"), F.col("doc_id"))).alias("real"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    with temporary():
        labels = written(linked_classes(narrow, classes, shingle, percent), "near-labels", kept=True)
    of_class = classes.join(labels, F.col("class_id") == F.col("node"), "left").select(
        "set1", "set2", F.coalesce("label", "class_id").alias("component"), "real"
    )
    rows = made.join(of_class, ["set1", "set2"], "left").withColumn(
        # an id that has several sets is one node: its component is the least of theirs
        "component", F.coalesce("component", "doc_id")
    )
    with shuffles_released(docs.sparkSession):
        all_known = made.where("NOT has_id").isEmpty()
    if all_known:
        least = rows.withColumn("least", F.col("component"))
    else:
        # A number made from a text is no id: the smallest real one of the component counts.
        real = of_class.groupBy("component").agg(F.min("real").alias("least"))
        least = rows.join(real, "component", "left").withColumn(
            "least", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.when(F.col("has_id"), F.col("doc_id")))
        )
    own = F.when(F.col("has_id"), F.col("doc_id"))
    # Without any id, the text under whose number the component goes stays, and every empty one.
    unnamed = F.col("least").isNull() & (F.col("doc_id") == F.col("component"))
    return least.select(
        own.alias("doc_id"),
        "doc_key",
        "n_shingles",
        F.col("least").alias("component_id"),
        F.coalesce(own == F.col("least"), unnamed).alias("kept"),
    )


def linked_classes(narrow: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, label: the component of every class that is linked with another one."""
    members = classes.select("class_id", "n_shingles", F.explode("bands").alias("band"))
    several = (
        members.groupBy("band")
        .agg(F.min("class_id").alias("low"), F.max("class_id").alias("high"))
        .where("low < high")
    )
    shared = written(members.join(several.select("band", "low"), "band"), "near-buckets")
    wanted = shared.select(F.col("class_id").alias("doc_id")).distinct()
    chosen = narrow.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = written(packed_sets(chosen, shingle), "near-sets", more=SMALL_BATCHES)

    labels, links = None, None
    for turn in range(ROUNDS):
        asked = written(hub_pairs(labelled(shared, labels), turn, percent), "near-pairs")
        found = written(confirmed(asked, sets, percent), "near-links", more=SMALL_BATCHES)
        links = found if links is None else links.union(found)
        n_asked, n_found = asked.count(), found.count()
        if n_found:
            labels = components(links)
        if n_found <= n_asked * FEW:
            break
    sketches = classes.select("class_id", "sketch").join(homes(shared), "class_id")
    cells = written(apart(labelled(shared, labels), sketches), "near-cells", more=SMALL_BATCHES)
    return components(links.union(confirmed_in_cells(cells, sets, percent)))
