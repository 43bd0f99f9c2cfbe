"""Benchmark decontamination by a distributed positional inverted index.

The benchmark's words are looked up in the corpus in two passes over it. The first
counts every benchmark word. In each window of a benchmark item the rarest word is the
anchor; neighbouring windows mostly share one. The second pass is the index proper: it
stores the postings (document, position, the words within reach) of the anchors alone,
shifts each posting by the anchor's offset in its item, and intersects it with the
other words' positions, so that every window that a document holds is found exactly
once. A window with a word that the corpus lacks is dropped at once.

``proximity`` gives the windows where only a share of the words agree, looked up by several
anchors each, so that no allowed set of mismatches hits them all.

All steps are DataFrame functions. Postings meet anchors by a broadcast join while the
benchmark has at most ``MAX_BROADCAST_WORDS`` words, counted beforehand; beyond that by
a shuffled join. That count and the anchors, as many as benchmark words at most, come to
the driver; more than ``MAX_TERMS`` anchors are looked up in several passes.

Words are runs of digits, letters and characters from U+0080, with A-Z lowered. Null
and empty texts have no words and no hits. Rows with equal id and text give equal
results, one for each row; rows that share only the id are told apart. Items without an
id hit, but are not listed. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersely.llm.common import text_key, written
from tersely.llm.url_rules import lower_ascii

#: What is not in a word; the contract's class, with A-Z still to be lowered (fixed value).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands behind a document's last word; no word can hold it.
END = "\u0000"
MAX_BROADCAST_WORDS = 1_000_000
#: Anchors looked up in one pass over the corpus; longer benchmarks take several.
MAX_TERMS = 100_000


def parts_of(text: Column) -> Column:
    """The words in order; the first and last part are empty if the text begins or ends between words."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def n_words(parts: Column) -> Column:
    first, last = F.get(parts, F.lit(0)) == "", F.get(parts, F.size(parts) - 1) == ""
    return (
        F.size(parts)
        - first.cast("int")
        - (last & (F.size(parts) > 1)).cast("int")
    ).cast("long")


def index_term(word: Column) -> Column:
    """What words are looked up by. Lowering all letters is quick and joins no fewer words."""
    return F.lower(word)


def item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, item_key, at, word, term of every benchmark word; repeated rows once."""
    items = benchmark.select(
        F.col(id_col).alias("item_id"),
        text_key(text_col).alias("item_key"),
        parts_of(F.col(text_col)).alias("parts"),
    ).dropDuplicates(["item_id", "item_key"])
    words = F.filter("parts", lambda w: w != "")
    return items.select("item_id", "item_key", F.posexplode(words).alias("at", "word")).select(
        "item_id",
        "item_key",
        "at",
        lower_ascii(F.col("word")).alias("word"),
        index_term(lower_ascii(F.col("word"))).alias("term"),
    )


def anchors(words: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """Per item and anchor: term, back (words of ``phrase`` before it), phrase, size of a window.

    ``phrase`` spans all windows whose rarest word is this one. Windows with words that
    the corpus lacks have no anchor.
    """
    counted = words.join(counts, "term", "left").na.fill(0, ["n"])
    item = Window.partitionBy("item_id", "item_key")
    ahead = item.orderBy("at").rowsBetween(0, window - 1)
    rarest = F.min(F.struct("n", "at")).over(ahead)
    last_start = F.greatest(F.lit(0), F.count("*").over(item) - window)
    chosen = counted.select(
        "item_id",
        "item_key",
        F.struct(
            "at",
            "word",
            "term",
            F.when(
                (F.col("at") <= last_start) & (rarest["n"] > 0), rarest["at"]
            ).alias("anchor"),
        ).alias("w"),
    )
    whole = chosen.groupBy("item_id", "item_key").agg(F.sort_array(F.collect_list("w")).alias("w"))
    starts = F.col("w.anchor")
    first = F.array_position(starts, F.col("anchor")).cast("int") - 1
    last = F.size("w") - F.array_position(F.reverse(starts), F.col("anchor")).cast("int")
    size = F.least(F.lit(window), F.size("w"))
    return (
        whole.withColumn("anchor", F.explode(F.array_distinct(F.array_compact(starts))))
        .select(
            F.element_at("w.term", F.col("anchor") + 1).alias("term"),
            "item_id",
            (F.col("anchor") - first).alias("back"),
            F.slice("w.word", first + 1, last - first + size).alias("phrase"),
            size.alias("window"),
        )
    )


def bounded(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= MAX_BROADCAST_WORDS else small


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    near: float | None = None,
) -> DataFrame:
    """Aligned phrases: doc_id, doc_key, n_words, item_id, start, agree, window.

    ``agree`` tells for each word of the phrase whether the document has it at its
    place, the first at word ``start`` of the document (counted from 0). Every row of
    ``docs`` also gives one row without an item. With ``near``, a share of words, the
    anchors are those of ``near_anchors``, and there is a column windows.
    """
    words = item_words(benchmark, item_id_col, item_text_col)
    size = words.count()
    spark = docs.sparkSession
    parts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(text_col).alias("doc_key"),
        parts_of(F.col(text_col)).alias("parts"),
    )
    counts = (
        parts.select(F.explode_outer("parts").alias("word"))
        .select(index_term(F.col("word")).alias("term"))
        .join(bounded(words.select("term").distinct(), size), "term")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    wanted = written(
        anchors(words, counts, window) if near is None else near_anchors(words, counts, near, window), "anchors"
    )
    terms = sorted(row.term for row in wanted.select("term").distinct().collect())
    passes = [terms[at : at + MAX_TERMS] for at in range(0, len(terms), MAX_TERMS)] or [[]]
    found = reduce(
        DataFrame.unionByName,
        [postings(parts, some, window, header=n == 0) for n, some in enumerate(passes)],
    )
    nothing = {name: F.lit(None).cast(kind).alias(name) for name, kind in wanted.dtypes}
    header = spark.range(1).select(*(nothing | {"term": F.lit(END).alias("term")}).values())
    place = F.col("at") - F.col("back") - F.col("begin")  # of the phrase in the context
    agree = F.transform(
        "phrase",
        lambda word, i: F.coalesce(lower_ascii(F.get("context", place + i)) == word, F.lit(False)),
    )
    return found.join(bounded(wanted.unionByName(header), size), "term").select(
        "doc_id",
        "doc_key",
        F.when(F.col("term") == END, F.col("n_words")).alias("n_words"),
        "item_id",
        (F.col("at") - F.col("back") - F.col("lead")).alias("start"),
        agree.alias("agree"),
        "window",
        *(["windows"] if near is not None else []),
    )


def postings(parts: DataFrame, terms: list[str], window: int, header: bool) -> DataFrame:
    """doc_id, doc_key, n_words, lead, term, at, begin, context: where the terms stand.

    ``context`` holds the parts around place ``at`` that a window there can reach, from
    part ``begin``. With ``header`` each document also gives one posting of ``END``.
    """
    listed = ", ".join(f"'{term}'" for term in [*terms, END])  # words hold no quotes
    places = F.expr(
        "filter(sequence(0, size(parts) - 1), "
        f"i -> lower(get(parts, i)) IN ({listed}))"
    )
    begin = lambda at: F.greatest(at - (window - 1), F.lit(0))
    stood = F.transform(
        places,
        lambda at: F.struct(
            F.lower(F.get("parts", at)).alias("term"),
            at.alias("at"),
            begin(at).alias("begin"),
            F.slice("parts", begin(at) + 1, at + window - begin(at)).alias("context"),
        ),
    )
    first = F.struct(
        F.lit(END).alias("term"),
        F.lit(None).cast("int").alias("at"),
        F.lit(None).cast("int").alias("begin"),
        F.lit(None).cast("array<string>").alias("context"),
    )
    rows = F.concat(F.array(first), stood) if header else stood
    return parts.select(
        "doc_id",
        "doc_key",
        n_words(F.col("parts")).alias("n_words"),
        (F.get("parts", F.lit(0)) == "").cast("int").alias("lead"),
        F.explode_outer(rows).alias("posting"),
    ).select("doc_id", "doc_key", "n_words", "lead", "posting.*")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
) -> DataFrame:
    """Per row of ``docs``: doc_id, doc_key, n_words, hits (start and size), items.

    ``hits`` are the places where a window of ``window`` consecutive item words stands,
    or a whole shorter item; ``items`` are the sorted ids, as strings, that they are of.
    """
    aligned = matches(docs, benchmark, id_col, text_col, item_id_col, item_text_col, window)
    windows = F.sequence(F.lit(0), F.size("agree") - F.col("window"))
    whole = F.filter(
        windows, lambda j: ~F.array_contains(F.slice("agree", j + 1, F.col("window")), False)
    )
    hits = F.transform(
        whole,
        lambda j: F.struct((F.col("start") + j).alias("start"), F.col("window").alias("size")),
    )
    found = aligned.select(
        "doc_id", "doc_key", "n_words", "item_id", F.when(F.col("agree").isNotNull(), hits).alias("hits")
    ).where("n_words IS NOT NULL OR size(hits) > 0")
    grouped = found.groupBy("doc_id", "doc_key").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").cast("int").alias("rows"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.sort_array(F.transform(F.collect_set("item_id"), lambda i: i.cast("string"))).alias("items"),
    )
    once = grouped.withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("rows"))))
    return once.select("doc_id", "doc_key", "n_words", "hits", "items")


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """``contamination`` with n_hit, n_items and contaminated: one word in ``share`` or more is hit."""
    places = F.flatten(
        F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))
    )
    return found.select(
        "*",
        F.size(F.array_distinct(places)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))


def near_anchors(words: DataFrame, counts: DataFrame, least: float, window: int) -> DataFrame:
    """Per item and place that is an anchor: term, back (words of ``phrase`` before it), phrase, windows, window.

    Each window's anchors are as many of its rarest places that no allowed set of mismatches
    hits them all. ``phrase`` is what windows around the anchor can reach, ``windows`` the
    places in it where a window begins that has this anchor.
    """
    counted = words.join(counts, "term", "left").na.fill(0, ["n"])
    item = Window.partitionBy("item_id", "item_key")
    size = F.least(F.lit(window), F.count("*").over(item)).cast("int")
    # the fewest words that must agree; shares are compared as in ``proximity``
    needed = F.expr(f"size(filter(sequence(1, window), i -> i / window < {least!r}D)) + 1")
    placed = (
        counted.withColumn("window", size)
        .withColumn("total", F.count("*").over(item))
        .withColumn("near", F.sort_array(F.collect_list(F.struct("n", "at")).over(
            item.orderBy("at").rowsBetween(0, window - 1)
        )))
        .withColumn("picks", F.col("window") - F.least(F.col("window"), F.greatest(F.lit(1), needed)) + 1)
    )
    starts = (
        placed.where(F.col("at") + F.col("window") <= F.col("total"))
        .select(
            "item_id",
            "item_key",
            "window",
            F.col("at").alias("start"),
            F.explode(F.slice("near", F.lit(1), F.col("picks"))["at"]).alias("at"),
        )
        .groupBy("item_id", "item_key", "at", "window")
        .agg(F.sort_array(F.collect_list("start")).alias("starts"))
    )
    whole = placed.groupBy("item_id", "item_key").agg(
        F.sort_array(F.collect_list(F.struct("at", "word", "term"))).alias("w")
    )
    same = F.col("s.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("s.item_key") == F.col("i.item_key"))
    first = F.col("starts")[0]
    return (
        starts.alias("s").join(whole.alias("i"), same)
        .select(
            F.element_at("w.term", F.col("at") + 1).alias("term"),
            F.col("s.item_id").alias("item_id"),
            (F.col("at") - first).alias("back"),
            F.slice("w.word", first + 1, F.element_at("starts", -1) - first + F.col("window")).alias("phrase"),
            F.transform("starts", lambda start: start - first).alias("windows"),
            "window",
        )
    )


def proximity(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, window: int = 13, **columns
) -> DataFrame:
    """Windows of an item that agree in a share of ``least`` or more of their words with as many
    consecutive words of a document: doc_id, item_id, start, share.

    One row for each document, item and start, with the share of its best window. A shorter item
    is one window. At ``least`` 0 or below, a window must agree in one word. Words beyond the
    document's ends agree with nothing, so a start may lie before its first word.
    """
    aligned = matches(docs, benchmark, window=window, near=least, **columns).where("agree IS NOT NULL")
    places = F.transform(
        "windows",
        lambda j: F.struct(
            (F.col("start") + j).alias("start"),
            (F.size(F.filter(F.slice("agree", j + 1, F.col("window")), lambda a: a)) / F.col("window")).alias("share"),
        ),
    )
    return (
        aligned.select("doc_id", "doc_key", "item_id", F.explode(places).alias("hit"))
        .select("doc_id", "doc_key", "item_id", "hit.*")
        .where((F.col("share") >= least) & (F.col("share") > 0))
        .groupBy("doc_id", "doc_key", "item_id", "start")
        .agg(F.max("share").alias("share"))
        .drop("doc_key")
    )
