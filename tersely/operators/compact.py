"""Rewrite the structured parts of documents when that makes them shorter.

Everything but nested JSON is decided and rewritten inside the document's row:
no shuffle but one of the raw texts before all work. Only documents that may hold JSON, by a
cheap look at the text, are shuffled once more, by their content. Every document is classified once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.functions import compact_form as form
from tersely.functions import delimited, json_text, logs, traces, yaml_text
from tersely.functions.scoring import kind_score
from tersely.functions.text import compression_ratio, input_bytes, let
from tersely.operators.hooks import BUILTIN, HEURISTIC, Compressor, Estimator
from tersely.operators.json_docs import ROW_KEY, numbered, value_line, value_rows
from tersely.operators.segments import block_texts, line_ranges_of, materialise, segments_of
from tersely.operators.skew import spread_rows

# --- fixed values -----------------------------------------------------------
RULE_OF_KIND = {
    "json": "json",
    "yaml": "yaml",
    "log": "logs",
    "stacktrace": "stacktraces",
    "tree": "trees",
    "table": "tables",
}
MIN_CONFIDENCE = 0.65
THRESHOLD = 0.3
DISABLED = "compression disabled by config; kept original"
UNSURE = "confidence below threshold; kept original"
LOW_SCORE = "compression score below threshold; kept original"
UNSUPPORTED = "unsupported segment type; kept original"
TREE_KEPT = "tree-like input already compact; kept original"
NOT_SHORTER = "rewrite did not reduce estimated tokens"
TOO_LARGE = "input exceeds max_input_bytes"
# ----------------------------------------------------------------------------


@dataclass(frozen=True, eq=False)
class Options:
    """Settings of a compaction.

    Compared by identity, so expressions built for an instance can be reused.
    """

    format_version: str = "1"
    max_input_bytes: int | None = None
    threshold: float = THRESHOLD
    min_confidence: float = MIN_CONFIDENCE
    rules: Mapping[str, bool] = field(default_factory=dict)
    estimator: Estimator = HEURISTIC
    compressors: tuple[Compressor, ...] = ()
    transformers: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    def enabled(self, kind: Column) -> Column:
        """Rule toggle of a kind; kinds without a rule are on."""
        off = [k for k, rule in RULE_OF_KIND.items() if not self.rules.get(rule, True)]
        return ~kind.isin(*off) if off else F.lit(True)


DEFAULTS = Options()


def gate(segment: Column, options: Options) -> Column:
    """Why a structured segment is kept as it is; NULL if it may be rewritten."""
    kind, text = segment["kind"], segment["text"]
    return (
        F.when(~options.enabled(kind), F.lit(DISABLED))
        .when(segment["confidence"] < options.min_confidence, F.lit(UNSURE))
        .when(kind_score(text, kind) < options.threshold, F.lit(LOW_SCORE))
    )


def _own_form(text: Column, kind: Column, json_form: Column, options: Options) -> Column:
    """Default rewrite of a kind, user transformers first."""
    out = (
        F.when(kind == "json", json_form)
        .when(kind == "yaml", yaml_text.record_block(text))
        .when(kind == "log", logs.record_block(text))
        .when(kind == "table", let(delimited.parse_rows(text), delimited.list_block))
        .when(kind == "stacktrace", traces.list_block(text))
    )
    for name, rewrite in options.transformers.items():
        out = F.when(kind == name, rewrite(text)).otherwise(out)
    return out


def _own_reason(kind: Column) -> Column:
    return (
        F.when(kind == "stacktrace", F.lit("compressed stack trace into compact format"))
        .when(kind == "tree", F.lit(TREE_KEPT))
        .when(kind == "unknown", F.lit(UNSUPPORTED))
        .otherwise(F.concat(F.lit("compressed "), kind, F.lit(" into compact format")))
    )


@cache
def _gates(options: Options) -> Column:
    open_gate = lambda s: F.when(s["kind"] != "plain", gate(s, options))
    return F.when(F.col("_stop").isNull(), F.transform("_segments", open_gate))


@cache
def _candidates(compressor: Compressor) -> Column:
    return compressor.compress(F.col("_open"))


@cache
def _chosen(options: Options) -> Column:
    """New text and note of every open segment: first accepted candidate, else own form."""
    chains = [BUILTIN, *options.compressors]

    def choose(s: Column, i: Column) -> Column:
        own_text = _own_form(
            s["text"], s["kind"], F.try_element_at(F.col("_forms"), i + 1), options
        )
        chosen = F.struct(own_text.alias("new_text"), _own_reason(s["kind"]).alias("note"))
        for n, compressor in reversed(list(enumerate(chains))):
            candidate = F.get(F.col(f"_cand{n}"), i)
            accepted = candidate.isNotNull() & (
                F.get(F.col(f"_size{n}"), i) < F.get(F.col("_sizes"), i)
            )
            note = F.concat(F.lit("compressed with plugin "), compressor.name_of(s["kind"]))
            chosen = F.when(
                accepted, F.struct(candidate.alias("new_text"), note.alias("note"))
            ).otherwise(chosen)
        return F.when(s.isNotNull(), chosen)

    return F.transform("_open", choose)


def _prepared(documents: DataFrame, text_col: str, options: Options) -> DataFrame:
    """Documents with their segments, gates and the segments open to a rewrite."""
    text = F.col(text_col)
    docs = materialise(documents, _segments=segments_of(text_col))
    if options.format_version not in form.FORMAT_VERSIONS:
        stop = F.lit(f"unsupported format version {options.format_version}")
    elif options.max_input_bytes is None:
        stop = F.lit(None)
    else:
        stop = F.when(input_bytes(text) > options.max_input_bytes, F.lit(TOO_LARGE))
    docs = docs.withColumn("_stop", stop.cast("string"))
    docs = materialise(docs, _gates=_gates(options))
    may_rewrite = F.transform(
        "_segments",
        lambda s, i: F.when((s["kind"] != "plain") & F.get("_gates", i).isNull(), s),
    )
    return materialise(docs, _open=F.when(F.col("_stop").isNull(), may_rewrite))


def _with_rewrites(docs: DataFrame, options: Options) -> DataFrame:
    """Documents with the rewrite of every segment; ``_forms`` holds the JSON ones."""
    estimate = options.estimator
    texts = F.transform("_open", lambda s: s["text"])
    chains = [BUILTIN, *options.compressors]
    docs = materialise(
        docs,
        _sizes=estimate.many(texts),
        **{f"_cand{n}": _candidates(c) for n, c in enumerate(chains)},
    )
    docs = materialise(
        docs, **{f"_size{n}": estimate.many(F.col(f"_cand{n}")) for n in range(len(chains))}
    )
    docs = materialise(docs, _chosen=_chosen(options))

    def finished(s: Column, i: Column) -> Column:
        chosen = F.get("_chosen", i)
        return F.struct(
            s["kind"].alias("kind"),
            s["source"].alias("source"),
            s["text"].alias("text"),
            s["confidence"].alias("confidence"),
            chosen["new_text"].alias("new_text"),
            F.coalesce(chosen["note"], F.get("_gates", i), s["reason"]).alias("reason"),
            s["lead"].alias("lead"),
            s["trail"].alias("trail"),
        )

    return materialise(docs, segments=F.transform("_segments", finished))


def _decided(docs: DataFrame, text_col: str, options: Options) -> DataFrame:
    """Reassemble the text, keep it only if it is shorter, add the decision."""
    text = F.col(text_col)
    estimate = options.estimator
    joined = F.array_join(
        F.transform("segments", lambda s: F.coalesce(s["new_text"], s["text"])), ""
    )
    docs = materialise(
        docs,
        _any=F.exists("segments", lambda s: s["new_text"].isNotNull()),
        _joined=F.when(F.col("_stop").isNull(), joined).otherwise(text),
    )
    docs = materialise(
        docs, input_tokens=estimate.one(text), _joined_tokens=estimate.one(F.col("_joined"))
    )
    revert = F.col("_any") & (F.col("_joined_tokens") >= F.col("input_tokens"))
    notes = F.transform(
        F.filter("segments", lambda s: s["reason"].isNotNull()),
        lambda s: F.concat(s["kind"], F.lit(": "), s["reason"]),
    )
    skipped = F.array(
        F.when(
            F.col("_stop") == TOO_LARGE,
            F.lit("Skipped rewrite because input exceeded max_input_bytes."),
        ).otherwise(
            F.lit(f"Skipped rewrite because format version {options.format_version} is unsupported.")
        )
    )
    docs = docs.withColumn("_revert", revert)
    output = F.when(F.col("_revert"), text).otherwise(F.col("_joined"))
    tokens = F.when(F.col("_revert"), F.col("input_tokens")).otherwise(F.col("_joined_tokens"))
    kept = F.col("_revert") | F.col("_stop").isNotNull()
    docs = docs.select(
        "*",
        output.alias("output"),
        (F.col("_any") & ~kept & (F.col("_joined") != text)).alias("transformed"),
        F.when(F.col("_any") & ~kept, F.lit("transformed"))
        .otherwise(F.lit("pass-through"))
        .alias("action"),
        F.coalesce(
            F.col("_stop"),
            F.when(F.col("_revert"), F.lit(NOT_SHORTER)).otherwise(F.lit("ok")),
        ).alias("reason"),
        F.lit(estimate.name).alias("estimator"),
        tokens.alias("output_tokens"),
        F.when(F.col("_stop").isNotNull(), skipped)
        .when(F.col("_revert"), F.array_append(notes, F.lit(f"pass-through: {NOT_SHORTER}")))
        .otherwise(notes)
        .alias("explanations"),
    )
    return docs.select(
        *[c for c in docs.columns if not c.startswith("_")],
    ).withColumn("delta_tokens", F.col("output_tokens") - F.col("input_tokens"))


def _may_hold_json(text: Column) -> Column:
    """Cheap test that every document with a JSON segment passes."""
    start = r"(?U)^[\s\x1C-\x1F]*(?:[\[{\"\-0-9]|true|false|null)"
    return F.coalesce(text.rlike(start) | F.contains(text, F.lit("```")), F.lit(False))


@cache
def _token_entries() -> Column:
    """Tokens of all open JSON segments of ``_row`` with segment and position."""
    entries = lambda s, i: F.transform(
        json_text.tokens(F.coalesce(F.try_element_at("_row._plain", s["text"]), s["text"])),
        lambda t, pos: F.struct((i + 1).alias("seg"), pos.alias("pos"), t.alias("t")),
    )
    # Asked of all segments: documents stopped by a guard have no open ones.
    found = F.transform(
        "_row._segments",
        lambda s, i: F.when(F.get("_row._open", i)["kind"] == "json", entries(s, i)),
    )
    return F.flatten(F.filter(found, lambda listed: listed.isNotNull()))


@cache
def _line() -> Column:
    return value_line()


def _json_forms(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with the compact form of each open JSON segment.

    The document row itself travels as entry 0 next to the token rows, so it
    is neither joined back nor shuffled twice.
    """
    payload = [c for c in docs.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in payload])
    docs = docs.withColumn("_row", row).select(*keys, "_row")
    rows = docs.withColumn("_entries", _token_entries())
    head = F.struct(F.lit(0).alias("seg"), F.lit(0).alias("pos"), F.get("_entries", F.lit(-1))["t"].alias("t"))
    rows = rows.select(
        *keys, "_row", F.posexplode(F.concat(F.array(head), F.col("_entries"))).alias("_at", "_e")
    ).select(
        *keys,
        F.when(F.col("_at") == 0, F.col("_row")).alias("_row"),
        F.col("_e.seg").alias("seg"),
        F.col("_e.pos").alias("pos"),
        F.col("_e.t").alias("t"),
    )
    lines = value_rows(rows, [*keys, "seg"]).select(
        *keys, "seg", "pos", "_row", F.when(F.col("seg") > 0, _line()).alias("line")
    )
    blocks = lines.groupBy(*keys, "seg").agg(
        F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY pos)").alias("block"),
        F.first("_row", ignorenulls=True).alias("_row"),
    )
    joined = blocks.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(
                F.when(
                    F.col("seg") > 0,
                    F.struct("seg", F.concat(F.col("block"), F.lit("\n")).alias("block")),
                )
            )
        ).alias("_forms"),
        F.first("_row", ignorenulls=True).alias("_row"),
    )
    return joined.select("_forms", *[F.col(f"_row.{c}").alias(c) for c in payload])


def compact_documents(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    options: Options | None = None,
) -> DataFrame:
    """Documents with their compacted text, decision, tokens and segments.

    Each row is a document of its own: ids may repeat or be NULL. Other columns
    pass through. Rows are spread by content and numbered where they arrive, so
    a repeated task gives the same rows.
    """
    options = options or DEFAULTS
    documents = spread_rows(documents, id_col, text_col)
    may_hold = _may_hold_json(F.col(text_col))
    here = _prepared(documents.filter(~may_hold), text_col, options)
    here = here.withColumn("_forms", F.lit(None).cast("map<int,string>"))
    in_row = _decided(_with_rewrites(here, options), text_col, options)
    # Texts that repeat a key are resolved before the second shuffle, which the windows rely on.
    repeating = json_text.repeating_texts(block_texts(F.col(text_col)))
    candidates = materialise(documents.filter(may_hold), _repeating=repeating)
    candidates = candidates.withColumn("_plain", json_text.resolved_forms(F.col("_repeating"))).drop("_repeating")
    candidates = numbered(candidates, id_col, text_col)
    forms = _json_forms(_prepared(candidates, text_col, options), ROW_KEY)
    shuffled = _decided(_with_rewrites(forms, options), text_col, options)
    return in_row.unionByName(shuffled)


def segment_breakdown(results: DataFrame, id_col: str = "doc_id", options: Options | None = None) -> DataFrame:
    """One row per segment of a result: lines, tokens before and after, saving."""
    estimate = (options or DEFAULTS).estimator
    rows = results.select(
        id_col,
        F.posexplode(F.arrays_zip("segments", line_ranges_of("segments").alias("lines"))).alias(
            "p", "z"
        ),
    )
    before = F.col("z.segments.text")
    after = F.coalesce(F.col("z.segments.new_text"), before)
    return rows.select(
        id_col,
        (F.col("p") + 1).alias("seg_no"),
        F.col("z.segments.kind").alias("type"),
        F.col("z.segments.source").alias("source"),
        F.col("z.lines.line_start").alias("line_start"),
        F.col("z.lines.line_end").alias("line_end"),
        estimate.one(before).alias("input_tokens"),
        estimate.one(after).alias("output_tokens"),
        (estimate.one(before) - estimate.one(after)).alias("tokens_saved"),
        (after != before).alias("changed"),
        F.col("z.segments.reason").alias("reason"),
    )


def result_summary(results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decision and token figures per document."""
    return results.select(
        id_col,
        "action",
        "reason",
        "estimator",
        "input_tokens",
        "output_tokens",
        "delta_tokens",
        compression_ratio(F.col("input_tokens"), F.col("output_tokens")).alias("ratio"),
    )


def inspect_payload(
    results: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    explanations: bool = True,
) -> DataFrame:
    """One JSON text per document: decision, tokens, size, segments, output."""
    estimate = HEURISTIC.one
    segments = F.transform(
        F.arrays_zip("segments", line_ranges_of("segments").alias("lines")),
        lambda z, i: let(
            F.coalesce(z["segments"]["new_text"], z["segments"]["text"]),
            lambda after: F.struct(
                (i + 1).alias("index"),
                z["segments"]["kind"].alias("type"),
                z["segments"]["source"].alias("source"),
                z["lines"]["line_start"].alias("line_start"),
                z["lines"]["line_end"].alias("line_end"),
                estimate(z["segments"]["text"]).alias("input_tokens"),
                estimate(after).alias("output_tokens"),
                (estimate(z["segments"]["text"]) - estimate(after)).alias("delta"),
                (after != z["segments"]["text"]).alias("changed"),
                z["segments"]["reason"].alias("reason"),
            ),
        ),
    )
    fields = [
        F.col("action"),
        F.col("reason"),
        F.col("estimator"),
        F.col("input_tokens").alias("estimated_input_tokens"),
        F.col("output_tokens").alias("estimated_output_tokens"),
        (F.col("input_tokens") - F.col("output_tokens")).alias("delta"),
        input_bytes(F.col(text_col)).alias("input_bytes"),
        segments.alias("segments"),
        F.col("output").alias("transformed"),
    ]
    if explanations:
        fields.append(F.col("explanations"))
    return results.select(
        id_col, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload")
    )
