"""Quality classifier: perplexity under a character model of trusted text.

The model is an interpolated modified Kneser-Ney model of ``ORDER`` characters for each
language. It is fitted on half of the trusted documents of a language, the ones with the
smallest hash of their text, however many they are; all others of them set the thresholds. Counts of the whole
order are occurrences, those of lower orders count different left neighbours; three
discounts per order and language come from the counts of counts.

Scoring covers all documents and all their characters in three steps. Every partition
emits its different n-grams, packed into one row for each shard; a shard is named by the
second and third last character, so that it holds all orders and contexts an n-gram needs
(those of one and two characters are in each). There the counts and contexts give each
n-gram the full interpolated probability, also where it was never seen; the probabilities
are handed back per partition, and each document's bits are summed where it lies. So texts
are never shuffled, and what is gathered from the corpus grows with it. If a partition is
cut in another way when it is read again, what it misses is looked up in the shards of the
other partitions. N-grams are looked up by 64-bit hashes.

A document's score is its mean number of bits per character, drawn towards its
language's mean by ``PRIOR`` characters, so that short texts are not judged by a single
odd string. It is kept if the score is at most a quantile of the scores of trusted
documents of its language that the model has not seen (of the one it has, if there is
only one). Digits count as one character.

Few insults in ordinary text do not move that mean. So a second model of the same kind is
fitted on half of the documents labelled toxic in each language, and
looked up in the same shards. ``toxic_score`` is the best passage's likelihood ratio: the
largest sum, over any run of characters, of the bits the toxic model saves, less ``DRIFT``
for each. It too must be at most a quantile of trusted documents that no model has seen. A
language without toxic labels has no such score and is judged by the first rule alone.

Null and empty texts have no score and are not kept. A null language is one of its own.
A language without trusted text has no model and keeps its documents. Repeated rows are
scored each; labels of one id count as trusted, or as toxic, only if all of them are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import (
    U64,
    breaks,
    folder,
    lean,
    mixed,
    placed,
    ragged,
    rolling,
    shuffles_released,
    slices,
    temporary,
    text_key,
    texts_of,
    written,
)

ORDER = 5
PRIOR = 60
QUANTILE = 0.99
#: Quantile of trusted rows' toxic scores, and bits a character must add to lengthen a passage.
TOXIC_QUANTILE = 0.99
DRIFT = 0.4
#: Stands before a language in the names of the toxic models (fixed value).
TOXIC = "\u0002"
MAX_BROADCAST_IDS = 1_000_000
SHARDS = 128
#: N-grams a partition holds back before it emits them, and most in one row.
HELD_GRAMS, ROW_GRAMS = 1_000_000, 50_000
#: Partitions whose n-grams of a shard go to one task.
PARTS_EACH = 64
#: Folder of the model's n-grams of one and two characters, which every shard needs.
SHORT = -1
#: Stand before and behind a text (fixed values).
BEGIN, END = "\u0002", "\u0003"


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all padded texts, where each text's n-grams begin, and how many it has."""
    padded = "".join(BEGIN * (ORDER - 1) + text + END for text in texts)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    counts = np.array([len(text) + 1 for text in texts], dtype=np.int64)
    starts = np.cumsum(counts + ORDER - 1) - (counts + ORDER - 1)
    return codes, starts, counts


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    return rolling(mixed(codes.astype(U64)), ORDER)


def language_groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Language, rows and texts of each language of a batch, without empty texts."""
    langs, texts = batch.column(batch.schema.get_field_index("lang")).to_pylist(), texts_of(batch, "text")
    rows: dict[str, list[int]] = {}
    for row, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        if text:
            rows.setdefault(lang or "", []).append(row)
    for lang, own in rows.items():
        yield lang, np.array(own), [texts[row] for row in own]


def distinct_grams(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Different n-grams of some texts and their counts."""
    codes, starts, counts = characters(texts)
    at = ragged(starts, counts)
    _, first, n = np.unique(gram_hashes(codes)[at], return_index=True, return_counts=True)
    whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[i : i + ORDER] for i in at[first].tolist()], n


def packed(grams: np.ndarray) -> bytes:
    """Rows of code points as one UTF-8 text."""
    return grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


def unpacked(texts: bytes, size: int) -> np.ndarray:
    """Rows of ``size`` code points each."""
    codes = texts.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(codes, "<u4").reshape(-1, size)


def row_hashes(grams: np.ndarray) -> np.ndarray:
    """``gram_hashes`` of rows of code points, of any size."""
    size = grams.shape[1]
    return rolling(mixed(grams.astype(U64)).ravel(), size)[::size] if len(grams) else np.zeros(0, U64)


class Index:
    """Places of 64-bit hashes in a sorted array without repeats, found from their first bits."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.shift = U64(64 - max(1, len(known).bit_length()))
        runs = np.arange(1 << (64 - int(self.shift)), dtype=U64) << self.shift
        self.first = np.searchsorted(known, runs)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it stands there."""
        last = len(self.known) - 1
        if last < 0:
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(self.first[hashes >> self.shift], last)
        found = self.known[at]
        low = np.flatnonzero((found < hashes) & (at < last))
        while len(low):
            at[low] += 1
            found[low] = self.known[at[low]]
            low = low[(found[low] < hashes[low]) & (at[low] < last)]
        return at, found == hashes


def shards_of(grams: np.ndarray) -> np.ndarray:
    """Shard of rows of code points; ``shard_column`` gives the same in Spark."""
    return (grams[:, -3].astype(np.int64) * 37 + grams[:, -2]) % SHARDS


def shard_column(context):
    """Shard of n-grams with this context; two characters of it or more have one."""
    of = F.ascii(F.substr(context, F.lit(-2), F.lit(1))) * 37 + F.ascii(F.substr(context, F.lit(-1), F.lit(1)))
    return F.when(F.length(context) >= 2, of % SHARDS).otherwise(SHORT).cast("int")


def gram_rows(docs: DataFrame) -> DataFrame:
    """part, lang, shard, grams: the different n-grams of every partition, packed."""

    def rows(part: int, pending: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, found in pending.items():
            grams = np.concatenate(found)
            grams = grams[np.lexsort(grams.T[::-1])]
            shard = shards_of(grams)
            order = np.argsort(shard, kind="stable")
            grams, shard = grams[order], shard[order]
            first = np.flatnonzero(breaks(shard))
            cuts = [
                (at, min(at + ROW_GRAMS, end))
                for start, end in zip(first, [*first[1:], len(shard)], strict=True)
                for at in range(start, end, ROW_GRAMS)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(cuts), part, np.int32)),
                    pa.array([lang] * len(cuts), pa.string()),
                    pa.array([shard[at] for at, _ in cuts], pa.int32()),
                    pa.array([packed(grams[at:end]) for at, end in cuts], pa.binary()),
                ],
                names=["part", "lang", "shard", "grams"],
            )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, pending, held = TaskContext.get().partitionId(), {}, {}, 0
        for batch in slices(batches, "text"):
            for lang, _, texts in language_groups(batch):
                codes, starts, counts = characters(texts)
                at = ragged(starts, counts)
                hashes = gram_hashes(codes)[at]
                known = seen.get(lang, np.zeros(0, U64))
                some = np.flatnonzero(~Index(known).places(hashes)[1])
                new, first = np.unique(hashes[some], return_index=True)
                seen[lang] = np.insert(known, np.searchsorted(known, new), new)
                grams = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[at[some[first]]]
                if len(grams):
                    pending.setdefault(lang, []).append(grams)
                    held += len(grams)
            if held >= HELD_GRAMS:
                yield from rows(part, pending)
                pending, held = {}, 0
        yield from rows(part, pending)

    return docs.select("lang", "text").mapInArrow(lean(emit), "part int, lang string, shard int, grams binary")


def counted_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for lang, _, texts in language_groups(batch):
                grams, n = distinct_grams(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array(grams), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"],
                )

    rows = docs.select("lang", "text").mapInArrow(lean(count), "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model of the texts: (lang, gram, share) and (lang, context, rest), all orders together.

    ``share`` is an n-gram's discounted share of its context, ``rest`` what the context
    leaves to the lower order.
    """
    level = written(counted_grams(docs), "counts")
    counts = level
    for size in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substr("gram", F.lit(2)).alias("gram")).agg(
            F.count("*").alias("n")
        )
        counts = counts.unionByName(level)
    counts = written(counts.withColumn("size", F.length("gram")), "orders")
    of = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in range(1, 5)]
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def discount(k: int):
        some = F.col(f"n{k}") > 0
        bent = k - (k + 1) * F.col("y") * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when(some, F.greatest(F.lit(0.0), bent)).otherwise(F.lit(0.5)).alias(f"d{k}")

    discounts = (
        counts.groupBy("lang", "size").agg(*of).withColumn("y", y)
        .select("lang", "size", *(discount(k) for k in (1, 2, 3)))
    )
    context = F.substr("gram", F.lit(1), F.col("size") - 1)
    contexts = (
        counts.groupBy("lang", "size", context.alias("context"))
        .agg(
            F.sum("n").alias("total"),
            F.count_if(F.col("n") == 1).alias("m1"),
            F.count_if(F.col("n") == 2).alias("m2"),
            F.count_if(F.col("n") >= 3).alias("m3"),
        )
        .join(discounts, ["lang", "size"])
        .withColumn("rest", (F.expr("d1 * m1 + d2 * m2 + d3 * m3")) / F.col("total"))
    )
    contexts = written(contexts.select("lang", "size", "context", "total", "rest", "d1", "d2", "d3"), "contexts")
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    shares = (
        counts.withColumn("context", context)
        .join(contexts, ["lang", "size", "context"])
        .select("lang", "gram", (F.greatest(F.lit(0.0), F.col("n") - less) / F.col("total")).alias("share"))
    )
    return written(shares, "shares"), contexts.select("lang", "context", "rest")


def sharded(shares: DataFrame, contexts: DataFrame, folder: str) -> None:
    """Write the model to ``folder``, one folder for each shard."""
    size = F.length("gram")
    rows = shares.select(
        shard_column(F.substr("gram", F.lit(1), size - 1)).alias("shard"),
        "lang",
        F.lit("share").alias("kind"),
        size.alias("size"),
        "gram",
        F.col("share").alias("value"),
    ).unionByName(
        contexts.select(
            shard_column(F.col("context")).alias("shard"),
            "lang",
            F.lit("rest").alias("kind"),
            F.length("context").alias("size"),
            F.col("context").alias("gram"),
            F.col("rest").alias("value"),
        )
    )
    with shuffles_released(rows.sparkSession):
        rows.repartition("shard").write.partitionBy("shard").parquet(folder)


class Shard:
    """The model's part for one shard: hashes and values by language, kind and size."""

    def __init__(self, folder: str, shard: int):
        store, root = pafs.FileSystem.from_uri(folder)
        self.values: dict[tuple[str, str, int], tuple[Index, np.ndarray]] = {}
        for name in (SHORT, shard):
            own = f"{root}/shard={name}"
            if store.get_file_info(own).type == pafs.FileType.Directory:
                names = ["lang", "kind", "size", "gram", "value"]
                self.learn(ds.dataset(own, filesystem=store, format="parquet").to_table(names))

    def learn(self, table: pa.Table) -> None:
        for key in table.group_by(["lang", "kind", "size"]).aggregate([]).to_pylist():
            rule = pc.and_(pc.equal(table["lang"], key["lang"]), pc.equal(table["kind"], key["kind"]))
            own = table.filter(pc.and_(rule, pc.equal(table["size"], key["size"])))
            texts = "".join(own["gram"].to_pylist()).encode("utf-8", "surrogatepass")
            hashes = row_hashes(unpacked(texts, key["size"])) if key["size"] else np.zeros(1, U64)
            order = np.argsort(hashes)
            self.values[key["lang"], key["kind"], key["size"]] = Index(hashes[order]), own["value"].to_numpy()[order]

    def value(self, lang: str, kind: str, grams: np.ndarray, default: float) -> np.ndarray:
        known = self.values.get((lang, kind, grams.shape[1]))
        if known is None:
            return np.full(len(grams), default)
        hashes = row_hashes(grams) if grams.shape[1] else np.zeros(len(grams), U64)
        at, there = known[0].places(hashes)
        return np.where(there, known[1][at], default)

    def bits(self, lang: str, grams: np.ndarray) -> np.ndarray | None:
        """Bits of each n-gram; null for a language without a model."""
        letters = self.values.get((lang, "share", 1))
        if letters is None:
            return None
        chance = np.full(len(grams), 1 / (len(letters[0].known) + 1))
        for size in range(1, ORDER + 1):
            rest = self.value(lang, "rest", grams[:, ORDER - size : -1], 1.0)
            chance = self.value(lang, "share", grams[:, ORDER - size :], 0.0) + rest * chance
        return -np.log2(chance)


def gram_bits(grams: DataFrame, folder: str) -> DataFrame:
    """The rows of ``grams`` with the bits of each n-gram, packed; languages without a model drop out.

    ``ratio`` holds how many bits fewer the toxic model needs, null where there is none.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model = None, None
        for batch in slices(batches, "grams"):
            out = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, model = row["shard"], Shard(folder, row["shard"])
                own = unpacked(row["grams"], ORDER)
                bits, toxic = model.bits(row["lang"], own), model.bits(TOXIC + row["lang"], own)
                if bits is not None:
                    ratio = None if toxic is None else (bits - toxic).astype(np.float32).tobytes()
                    out.append(row | {"bits": bits.tobytes(), "ratio": ratio})
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = {"part": pa.int32(), "lang": pa.string(), "shard": pa.int32()}
    schema = pa.schema(kinds | dict.fromkeys(("grams", "bits", "ratio"), pa.binary()))
    dealt = grams.repartition("shard", F.floor(F.col("part") / PARTS_EACH)).sortWithinPartitions("shard")
    return dealt.mapInArrow(lean(look_up), "part int, lang string, shard int, grams binary, bits binary, ratio binary")


class Probabilities:
    """Bits of n-grams from the files of a partition, and from those of others for what they miss."""

    def __init__(self, folder: str, part: int):
        self.store, root = pafs.FileSystem.from_uri(folder)
        self.parts = f"{root}/parts"
        self.known: dict[str, tuple[Index, np.ndarray]] = {}  # hashes, and rows of bits and ratio
        own = f"{self.parts}/part={part}"
        if self.store.get_file_info(own).type == pafs.FileType.Directory:
            self.learn(ds.dataset(own, filesystem=self.store, format="parquet"))

    def learn(self, rows: ds.Dataset, rule: ds.Expression | None = None, wanted: np.ndarray | None = None) -> None:
        """Take the n-grams of ``rows``, or those of the hashes ``wanted``."""
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in rows.to_batches(["lang", "grams", "bits", "ratio"], filter=rule, batch_size=64):
            for row in batch.to_pylist():
                hashes, bits = row_hashes(unpacked(row["grams"], ORDER)), np.frombuffer(row["bits"])
                ratio = np.zeros(len(bits)) if row["ratio"] is None else np.frombuffer(row["ratio"], np.float32)
                bits = np.stack([bits, ratio], axis=1)
                if wanted is not None:
                    some = np.isin(hashes, wanted)
                    hashes, bits = hashes[some], bits[some]
                found.setdefault(row["lang"], []).append((hashes, bits))
        for lang, own in found.items():
            if lang in self.known:
                own.append((self.known[lang][0].known, self.known[lang][1]))
            hashes, bits = (np.concatenate(column) for column in zip(*own, strict=True))
            hashes, first = np.unique(hashes, return_index=True)
            self.known[lang] = Index(hashes), bits[first]

    def of(self, lang: str, hashes: np.ndarray, grams) -> np.ndarray:
        """Bits and ratio of each hash of a language with a model. ``grams`` gives rows of code points by place."""
        found = self.found(lang, hashes)
        missing = np.flatnonzero(np.isnan(found[:, 0]))
        if not len(missing):
            return found
        shards = np.unique(shards_of(grams(missing))).tolist()
        rule = (ds.field("lang") == lang) & ds.field("shard").isin(shards)
        self.learn(ds.dataset(self.parts, filesystem=self.store, format="parquet"), rule, np.unique(hashes[missing]))
        return self.found(lang, hashes)

    def found(self, lang: str, hashes: np.ndarray) -> np.ndarray:
        if lang not in self.known:
            return np.full((len(hashes), 2), np.nan)
        known, bits = self.known[lang]
        at, there = known.places(hashes)
        found = bits[at]
        found[~there] = np.nan
        return found


def best_passages(ratio: np.ndarray, counts: np.ndarray, drift: float) -> list[float]:
    """Of each text the largest sum of ``ratio`` less ``drift`` over any run of its characters; 0 at least."""
    ends = np.cumsum(counts)
    out = []
    for first, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        total = np.concatenate([[0.0], np.cumsum(ratio[first:end] - drift)])
        out.append(float((total - np.minimum.accumulate(total)).max()))
    return out


def document_bits(docs: DataFrame, folder: str, langs: list[str]) -> DataFrame:
    """doc_id, doc_key, lang, n_chars (the end counts as one), bits, toxic_score; null without a model."""
    modelled = frozenset(langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances = Probabilities(folder, TaskContext.get().partitionId())
        for batch in slices(batches, "text"):
            n, bits = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan)
            toxic = np.full(batch.num_rows, np.nan)
            for lang, rows, texts in language_groups(batch):
                codes, starts, counts = characters(texts)
                n[rows] = counts
                if lang not in modelled:
                    continue
                at = ragged(starts, counts)
                hashes = gram_hashes(codes)[at]
                grams = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                own = chances.of(lang, hashes, lambda i: grams[at[i]])  # noqa: B023
                if np.isnan(own[:, 0]).any():
                    raise ValueError(f"n-grams of language {lang!r} have no probability")
                bits[rows] = np.add.reduceat(own[:, 0], np.cumsum(counts) - counts)
                toxic[rows] = best_passages(own[:, 1], counts, DRIFT)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pc.fill_null(batch.column(2), ""),
                    pa.array(n),
                    pa.array(bits, mask=np.isnan(bits)),
                    pa.array(toxic, mask=np.isnan(toxic)),
                ],
                names=["doc_id", "doc_key", "lang", "n_chars", "bits", "toxic_score"],
            )

    schema = "doc_id long, doc_key long, lang string, n_chars long, bits double, toxic_score double"
    return docs.select("doc_id", "doc_key", "lang", "text").mapInArrow(lean(score), schema)


def quality(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    prior: float = PRIOR,
    toxic_quantile: float = TOXIC_QUANTILE,
) -> DataFrame:
    """Per row of ``docs``: doc_id, doc_key, lang, n_chars, score (bits per character), threshold,
    toxic_score, toxic_threshold, kept.

    ``docs`` has doc_id, lang and text and should be a table, since it is read three
    times; ``labels`` has doc_id, quality and toxic, trusted where quality is 1 and
    toxic is 0 or null, toxic where toxic is 1.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("doc_key"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        "text",
    )
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marks = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.bool_and(F.coalesce(good, F.lit(False))).alias("good"),
            F.bool_and(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    trusted = marks.where("good").select("doc_id")
    classed = written(
        narrow.where("length(text) > 0").select("doc_id", "doc_key", "lang").distinct()
        .join(marks.where("good OR toxic").select("doc_id", "toxic"), "doc_id"),
        "labelled",
    )
    # Ranked by ranges of hashes, so that no task sorts a whole class.
    ranked = placed(classed, ["lang", "toxic"], ["doc_key", "doc_id"], "ranked")
    trained = written(ranked.where(2 * F.col("at") < F.col("of")).select("doc_id", "lang", "toxic").distinct(), "trained")
    few = trained.count() <= MAX_BROADCAST_IDS
    sample = narrow.join(F.broadcast(trained) if few else trained, ["doc_id", "lang"]).withColumn(
        "lang", F.when(F.col("toxic"), F.concat(F.lit(TOXIC), "lang")).otherwise(F.col("lang"))
    )
    with temporary():
        files = folder(spark, "perplexity")
        with temporary():
            shares, contexts = fitted(sample)
            sharded(shares, contexts, f"{files}/model")
        with shuffles_released(spark):
            bits = gram_bits(gram_rows(narrow), f"{files}/model").repartition("part")
            bits.write.partitionBy("part").parquet(f"{files}/parts")
        langs = [row.lang for row in trained.where("NOT toxic").select("lang").distinct().collect()]  # one for each language
        scored = written(document_bits(narrow, files, langs), "scores", kept=True)
    known = scored.where("bits IS NOT NULL").join(trusted, "doc_id")
    unseen = known.join(trained.select("doc_id", "lang"), ["doc_id", "lang"], "left_anti")
    means = known.groupBy("lang").agg((F.sum("bits") / F.sum("n_chars")).alias("mean"))
    score = (F.col("bits") + prior * F.col("mean")) / (F.col("n_chars") + prior)

    def limit(rows: DataFrame, name: str) -> DataFrame:
        drawn = rows.join(F.broadcast(means) if few else means, "lang").select(
            "lang", score.alias("score"), "toxic_score"
        )
        return drawn.groupBy("lang").agg(
            F.percentile_approx("score", quantile, 100_000).alias(name),
            F.percentile_approx("toxic_score", toxic_quantile, 100_000).alias(f"toxic_{name}"),
        )

    limits = means.join(limit(known, "seen"), "lang").join(limit(unseen, "unseen"), "lang", "left")
    limits = limits.select(
        "lang",
        "mean",
        F.coalesce("unseen", "seen").alias("threshold"),
        F.coalesce("toxic_unseen", "toxic_seen").alias("toxic_threshold"),
    )
    within = F.coalesce(score <= F.col("threshold"), F.lit(True)) & F.coalesce(
        F.col("toxic_score") <= F.col("toxic_threshold"), F.lit(True)
    )
    return scored.join(F.broadcast(limits) if few else limits, "lang", "left").select(
        "doc_id",
        "doc_key",
        "lang",
        "n_chars",
        score.alias("score"),
        "threshold",
        "toxic_score",
        "toxic_threshold",
        ((F.col("n_chars") > 0) & within).alias("kept"),
    )
