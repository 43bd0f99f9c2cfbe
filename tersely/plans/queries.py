"""The registered queries; each takes (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.functions import blocks, delimited, json_text, logs, scoring, traces
from tersely.functions import text as T
from tersely.operators import compact as C
from tersely.operators import records, reports, runs, segments
from tersely.operators.hooks import (
    batch_compressor,
    batch_estimator,
    column_compressor,
    python_compressor,
    python_estimator,
)
from tersely.operators.json_docs import json_compact, json_nodes
from tersely.plans import inputs
from tersely.session import configure
from tersely.sources import audit_log, snapshots
from tersely.sources import texts as text_files
from tersely.streaming import chunks as stream_chunks
from tersely.streaming import metrics as stream_metrics
from tersely.streaming import runs as stream_runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _events(spark, sf):
    return inputs.table(spark, sf, "events")


def _documents(spark, sf):
    return inputs.table(spark, sf, "documents")


def _prompts(spark, sf):
    return inputs.prompts(inputs.table(spark, sf, "conversations"))


def _results(spark, sf):
    return inputs.results(_documents(spark, sf), _events(spark, sf))


# --- logs --------------------------------------------------------------------


@query
def log_run_collapse(spark, sf):
    lines = inputs.log_lines(_events(spark, sf))
    return runs.collapse_line_runs(
        lines, ["user_id"], ["ts", "event_id"], bucket=inputs.time_slot()
    ).select("user_id", "event_id", "n", "line")


@query
def log_run_savings_by_user(spark, sf):
    lines = inputs.log_lines(_events(spark, sf))
    return runs.run_savings(lines, ["user_id"], ["ts", "event_id"], bucket=inputs.time_slot())


@query
def log_line_fields(spark, sf):
    lines = inputs.log_lines(_events(spark, sf))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("node "), F.col("line"))).otherwise(
        F.col("line")
    )
    return lines.select("event_id", logs.line_fields(line).alias("f")).select("event_id", "f.*")


@query
def log_repeated_lines(spark, sf):
    return runs.repeated_lines(inputs.log_lines(_events(spark, sf)), ["user_id"])


# --- tokens and scalar text ----------------------------------------------------


@query
def token_estimate_docs(spark, sf):
    text = F.col("text")
    return _documents(spark, sf).select(
        "doc_id",
        T.estimate_tokens(text).alias("tokens"),
        T.input_bytes(text).cast("long").alias("bytes"),
    )


@query
def token_budget_violations(spark, sf):
    return reports.budget_violations(_documents(spark, sf), 1000)


@query
def token_totals_by_lang(spark, sf):
    return reports.token_totals(_results(spark, sf), ["lang"])


@query
def compression_ratio_docs(spark, sf):
    return reports.with_ratio(
        _results(spark, sf).select("doc_id", "input_tokens", "output_tokens")
    )


@query
def token_budget_by_conversation(spark, sf):
    turns = inputs.table(spark, sf, "conversations")
    # Length of the joined text from per-turn lengths: nothing is collected.
    chars = (F.sum(F.length("text")) + F.count("*") - 1).alias("chars")
    sums = turns.groupBy("conv_id").agg(chars)
    tokens = T.tokens_of_chars(F.col("chars"))
    return sums.select("conv_id", tokens.alias("tokens"), (tokens > 700).alias("over"))


@query
def repeated_lines_docs(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", logs.repeated_line_count(F.col("text")).cast("long").alias("repeated")
    )


@query
def chunk_documents(spark, sf):
    return stream_chunks.chunk_documents(_documents(spark, sf), 500)


@query
def redact_and_hash(spark, sf):
    text = F.col("text")
    return inputs.env_lines(_events(spark, sf)).select(
        "event_id",
        T.redact_assignments(text).alias("redacted"),
        T.audit_hash(text).alias("input_hash"),
    )


@query
def redact_documents(spark, sf):
    text = F.col("text")
    return _documents(spark, sf).select(
        "doc_id",
        T.audit_hash(text).alias("input_hash"),
        T.content_hash(T.redact_keys(text, "token|password|secret")).alias("by_key"),
    )


@query
def unicode_trim_lines(spark, sf):
    text = F.col("text")
    return _documents(spark, sf).select(
        "doc_id",
        T.strip(text).alias("trimmed"),
        F.size(T.split_lines(text)).cast("long").alias("lines"),
        F.size(T.filled_lines(text)).cast("long").alias("filled"),
    )


# --- records and JSON ----------------------------------------------------------


@query
def pack_orders_by_customer(spark, sf):
    orders = inputs.table(spark, sf, "orders").select(
        "o_custkey",
        "o_orderdate",
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("prio"),
    )
    return records.pack_records(
        orders, ["o_custkey"], ["o_orderdate", "id"], ["id", "status", "prio"], "orders"
    )


@query
def pack_events_by_user(spark, sf):
    events = _events(spark, sf).select(
        "user_id",
        "ts",
        "event_id",
        F.concat(F.col("event_type"), F.lit(", \\"), F.col("props")).alias("what"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("seen"),
    )
    return records.pack_records(
        events, ["user_id"], ["ts", "event_id"], ["event_id", "what", "seen"], "events"
    )


@query
def pack_orders_in_blocks(spark, sf):
    """Blocks of 100 orders for each of three hot keys, dealt by ranges of 500 order keys."""
    orders = inputs.table(spark, sf, "orders").select(
        "o_orderstatus", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prio")
    )
    return records.pack_records(
        orders,
        ["o_orderstatus"],
        ["id"],
        ["id", "prio"],
        "orders",
        bucket=F.expr("id div 500"),
        rows_per_block=100,
    )


@query
def pack_lineitem_lines(spark, sf):
    items = inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"
    )
    cols = ["l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"]
    return records.pack_lines(items, ["l_orderkey"], ["l_linenumber", "l_partkey"], cols, "items")


@query
def homogeneous_record_test(spark, sf):
    docs = inputs.order_lists(inputs.table(spark, sf, "orders"), mixed=True)
    return docs.select("doc_id", records.is_record_list(F.col("text")).alias("records"))


@query
def json_predicate(spark, sf):
    props = F.col("props")
    return _events(spark, sf).select(
        "event_id",
        json_text.is_json(props).alias("whole"),
        json_text.is_json(F.concat(props, F.lit(" x"))).alias("garbage"),
        json_text.is_json(F.col("event_id").cast("string")).alias("scalar"),
        json_text.is_json(F.col("event_type")).alias("word"),
    )


@query
def json_node_rows(spark, sf):
    docs = inputs.order_lists(inputs.table(spark, sf, "orders"), mixed=True)
    return json_nodes(docs).select("doc_id", "depth", "key", "kind", "value", "children")


@query
def json_compact_docs(spark, sf):
    return json_compact(inputs.order_lists(inputs.table(spark, sf, "orders"), mixed=True))


@query
def compact_order_lists(spark, sf):
    docs = inputs.order_lists(inputs.table(spark, sf, "orders"), mixed=True)
    return C.compact_documents(docs, options=C.Options(threshold=0.0)).select("doc_id", "output", "action")


# --- segments ------------------------------------------------------------------


@query
def fence_segments(spark, sf):
    found = segments.segment_documents(_prompts(spark, sf))
    return found.select(
        "doc_id", F.col("seg_no").cast("long").alias("seg_no"), "kind", "source", "text", "confidence"
    )


@query
def nth_segment(spark, sf):
    found = segments.nth_segment(segments.segment_documents(_prompts(spark, sf)), 2)
    return found.select("doc_id", "kind", "text")


@query
def classify_documents(spark, sf):
    return _documents(spark, sf).select("doc_id", blocks.classify(F.col("text")).alias("kind"))


@query
def segment_type_counts(spark, sf):
    return segments.segment_type_counts(segments.segment_documents(_prompts(spark, sf)), None)


@query
def segment_line_ranges(spark, sf):
    docs = segments.materialise(_prompts(spark, sf), segments=segments.segments_of("text"))
    zipped = F.arrays_zip("segments", segments.line_ranges_of("segments").alias("r"))
    return docs.select("doc_id", F.posexplode(zipped).alias("p", "z")).select(
        "doc_id",
        (F.col("p") + 1).cast("long").alias("seg_no"),
        F.col("z.r.line_start").cast("long").alias("line_start"),
        F.col("z.r.line_end").cast("long").alias("line_end"),
    )


@query
def stack_elide(spark, sf):
    return inputs.traces(_events(spark, sf)).select(
        "doc_id", traces.elide_frames(F.col("text")).alias("elided")
    )


@query
def stack_list_form(spark, sf):
    return inputs.traces(_events(spark, sf)).select(
        "doc_id", traces.list_block(F.col("text")).alias("block")
    )


@query
def delimited_rows(spark, sf):
    docs = inputs.delimited_texts(inputs.table(spark, sf, "orders"))
    rows = docs.select("doc_id", F.posexplode(delimited.parse_rows(F.col("text"))).alias("p", "c"))
    return rows.select(
        "doc_id", F.col("p").cast("long").alias("row_no"), F.array_join("c", "|").alias("cells")
    )


@query
def delimited_list_form(spark, sf):
    docs = inputs.delimited_texts(inputs.table(spark, sf, "orders"))
    block = T.let(delimited.parse_rows(F.col("text")), delimited.list_block)
    return docs.select("doc_id", block.alias("block"))


# --- scores, gates, compaction ----------------------------------------------------


def _scored(spark, sf):
    found = segments.segment_documents(_prompts(spark, sf))
    score = scoring.compaction_score(F.col("text"), F.col("kind"))
    return found.select(
        "doc_id",
        F.col("seg_no").cast("long").alias("seg_no"),
        "kind",
        F.round(score, 4).alias("score"),
        scoring.score_confidence(F.col("kind")).alias("confidence"),
        scoring.score_label(F.col("kind")).alias("label"),
    )


@query
def compaction_score(spark, sf):
    return _scored(spark, sf)


def _rules(spark):
    return spark.createDataFrame([("yaml", False), ("log", True)], "kind string, enabled boolean")


@query
def rule_toggle(spark, sf):
    return reports.rule_gate(_scored(spark, sf), _rules(spark)).select(
        "doc_id", "seg_no", "kind", "enabled"
    )


@query
def threshold_gate(spark, sf):
    return reports.rule_gate(_scored(spark, sf), _rules(spark), 0.3).select(
        "doc_id", "seg_no", "kind", "open"
    )


@query
def compact_documents(spark, sf):
    out = C.compact_documents(_prompts(spark, sf))
    return out.select(
        "doc_id", "output", "transformed", "action", "reason", "input_tokens", "output_tokens"
    )


@query
def compact_explanations(spark, sf):
    out = C.compact_documents(_prompts(spark, sf))
    return out.select("doc_id", F.array_join("explanations", " | ").alias("notes"))


@query
def segment_breakdown(spark, sf):
    rows = C.segment_breakdown(C.compact_documents(_prompts(spark, sf)))
    return rows.select(
        "doc_id",
        F.col("seg_no").cast("long").alias("seg_no"),
        "type",
        "input_tokens",
        "output_tokens",
        "tokens_saved",
        "changed",
    )


@query
def never_inflate(spark, sf):
    out = C.compact_documents(inputs.props_documents(_events(spark, sf)))
    return out.select("doc_id", "output", "action", "reason", "delta_tokens")


@query
def size_and_rule_guards(spark, sf):
    options = C.Options(max_input_bytes=600, rules={"json": False})
    out = C.compact_documents(_prompts(spark, sf), options=options)
    return out.select(
        "doc_id",
        "action",
        "reason",
        F.exists("segments", lambda s: s["reason"].eqNullSafe(C.DISABLED)).alias("json_off"),
    )


@query
def result_summary(spark, sf):
    return C.result_summary(C.compact_documents(inputs.props_documents(_events(spark, sf))))


@query
def inspect_payload(spark, sf):
    out = C.compact_documents(inputs.props_documents(_events(spark, sf)))
    shape = (
        "action string, delta long, input_bytes long, transformed string, "
        "segments array<struct<type:string,line_end:long>>"
    )
    # Each payload is parsed once.
    payload = segments.materialise(C.inspect_payload(out), _said=F.from_json("payload", shape))
    first = F.get("_said.segments", F.lit(0))
    return payload.select(
        "doc_id",
        F.col("_said.action").alias("action"),
        F.col("_said.delta").alias("tokens_saved"),
        F.col("_said.input_bytes").alias("bytes"),
        first["type"].alias("type"),
        first["line_end"].alias("line_end"),
        F.col("_said.transformed").alias("output"),
    )


@query
def changed_lines(spark, sf):
    out = C.compact_documents(inputs.props_documents(_events(spark, sf)))
    return reports.changed_lines(out)


@query
def user_hooks(spark, sf):
    shout = column_compressor(
        "squeeze", lambda text, kind: kind == "json", lambda text: F.replace(text, F.lit('"'), F.lit(""))
    )
    options = C.Options(compressors=(shout,))
    out = C.compact_documents(inputs.props_documents(_events(spark, sf)), options=options)
    return out.select("doc_id", "output", "action")


@query
def python_hooks(spark, sf):
    words = python_estimator("words", lambda text: len(text.split(",")))
    merge = python_compressor(
        "first",
        lambda text, kind: kind == "json" and "," in text,
        lambda text: (text.split(",")[0], True),
    )
    options = C.Options(estimator=words, compressors=(merge,))
    out = C.compact_documents(inputs.props_documents(_events(spark, sf)), options=options)
    return out.select("doc_id", "output", "action", "input_tokens", "output_tokens")


# --- metrics, audit, checks ---------------------------------------------------------


@query
def metrics_totals(spark, sf):
    return reports.metrics_totals(_results(spark, sf))


@query
def metrics_by_tool(spark, sf):
    return reports.metrics_by_tool(_results(spark, sf)).orderBy("tool")


@query
def metrics_daily(spark, sf):
    return reports.metrics_daily(_results(spark, sf)).orderBy("day")


@query
def metrics_grouping_sets(spark, sf):
    return reports.metrics_cube(_results(spark, sf))


@query
def pass_through_reasons(spark, sf):
    return reports.pass_through_reasons(_results(spark, sf)).orderBy("reason")


@query
def daily_ratio(spark, sf):
    return reports.apply_ratio(reports.metrics_daily(_results(spark, sf))).select(
        "day", "attempted", "applied", "percent"
    )


@query
def metrics_snapshot(spark, sf):
    folder = inputs.scratch(spark, "snapshot")
    snapshots.write_snapshot(snapshots.snapshot(_results(spark, sf)), folder)
    snap = snapshots.read_snapshot(spark, folder)
    return snap.select(
        "transforms_attempted",
        "transforms_applied",
        "pass_through",
        "estimated_token_delta_total",
        F.size("by_tool").cast("long").alias("tools"),
        F.size("daily").cast("long").alias("days"),
        F.aggregate(
            F.map_values("by_tool"), F.lit(0).cast("long"), lambda a, b: a + b["delta"]
        ).alias("delta_by_tool"),
    )


def _audit(spark, sf):
    return audit_log.audit_rows(
        _results(spark, sf)
        .withColumn("action", F.when(F.col("transformed"), "transformed").otherwise("pass-through"))
        .withColumn("estimator", F.lit("heuristic-char4")),
        F.col("tool"),
        F.col("ts"),
        "1",
        "batch",
    )


@query
def audit_filter_tail(spark, sf):
    folder = inputs.scratch(spark, "audit")
    audit_log.append_records(_audit(spark, sf), folder)
    found = audit_log.filter_audit(audit_log.read_audit(spark, folder), "2024-01", "src1")
    return audit_log.tail_audit(found, 50, by_time=True).select(
        F.substring("ts", 1, 19).alias("ts"), "action", "delta_tokens", "input_hash"
    )


@query
def event_records(spark, sf):
    out = C.compact_documents(inputs.props_documents(_events(spark, sf)))
    when = F.timestamp_seconds(F.col("doc_id"))
    return audit_log.event_rows(out, when).select(
        F.substring("ts", 1, 19).alias("ts"),
        "type",
        "action",
        "prompt_hash",
        F.array_join("segment_types", ",").alias("segment_types"),
        "transformed",
    )


@query
def baseline_regression(spark, sf):
    sized = _results(spark, sf).withColumn("name", F.col("source"))
    current = reports.token_totals(sized, ["name"])
    early = sized.filter((F.col("lang") != "en") & (F.col("source") != "src7"))
    baseline = reports.token_totals(early, ["name"])
    return reports.regression_check(current, baseline, 0.05)


@query
def set_equality(spark, sf):
    docs = _documents(spark, sf)
    sources = docs.select(F.col("source").alias("tool"))
    renamed = docs.select(
        F.when(F.col("source") == "src5", "other").otherwise(F.col("source")).alias("tool")
    )
    return reports.set_difference(sources, renamed)


# --- stored state, guards and files ----------------------------------------------------


@query
def metrics_snapshot_updates(spark, sf):
    """A snapshot updated batch by batch; a batch number that comes again changes nothing."""
    folder = inputs.scratch(spark, "snapshot-updates")
    rows = _results(spark, sf)
    for batch_id, part in ((0, 0), (1, 1), (1, 2), (2, 2)):
        snapshots.update_snapshot(rows.filter(F.col("doc_id") % 3 == part), folder, batch_id)
    return snapshots.snapshot_rows(snapshots.current_snapshot(spark, folder))


@query
def metrics_snapshot_damaged(spark, sf):
    """A stored snapshot with a damaged total, a damaged block and no reasons, then an update."""
    folder = inputs.scratch(spark, "snapshot-damaged")
    rows = _results(spark, sf)
    snap = snapshots.snapshot(rows.filter(F.col("doc_id") % 3 == 0))
    text = F.to_json(F.struct(F.lit(0).alias("last_batch"), *snap.columns))
    for pattern, damaged in (
        (r'"transforms_applied":\d+', '"transforms_applied":-7'),
        (r'"src1":\{"attempted":\d+', '"src1":{"attempted":"none"'),
        (r'"pass_through_reasons":\{[^}]*\}', '"pass_through_reasons":[1]'),
    ):
        text = F.regexp_replace(text, pattern, damaged)
    snap.select(text.alias("value")).write.text(f"{folder}/slot=0")
    snapshots.update_snapshot(rows.filter(F.col("doc_id") % 3 != 0), folder, 1)
    return snapshots.snapshot_rows(snapshots.current_snapshot(spark, folder))


@query
def stored_baseline(spark, sf):
    folder = inputs.scratch(spark, "baseline")
    sized = _results(spark, sf).withColumn("name", F.col("source"))
    early = sized.filter((F.col("lang") != "en") & (F.col("source") != "src7"))
    snapshots.write_baseline(reports.token_totals(early, ["name"]), folder)
    current = reports.token_totals(sized, ["name"])
    return reports.regression_check(current, snapshots.read_baseline(spark, folder), 0.05)


@query
def audit_tail_file_order(spark, sf):
    """Records of one time: the later append comes last, and within it the later row."""
    folder = inputs.scratch(spark, "audit-tail")
    audit = _audit(spark, sf).withColumn("ts", F.lit("2024-03-01T00:00:00.000000+00:00"))
    for even in (True, False):
        part = audit.filter((F.col("input_tokens_est") % 2 == 0) == even)
        part = part.repartitionByRange(4, "input_hash", "tool").sortWithinPartitions("input_hash", "tool")
        audit_log.append_records(part, folder)
    found = audit_log.filter_audit(audit_log.read_audit(spark, folder), "2024-03", None)
    last = audit_log.tail_audit(found, 40).withColumn("place", F.monotonically_increasing_id())
    return last.select("place", "ts", "tool", "input_hash", "input_tokens_est")


@query
def texts_by_suffix(spark, sf):
    """Lines and characters of the text files of each market segment; files of another suffix are passed over."""
    folder = inputs.scratch(spark, "texts")
    names = inputs.table(spark, sf, "customer").select("c_name", "c_mktsegment")
    writer = lambda: names.write.mode("append").partitionBy("c_mktsegment")
    writer().text(folder)
    writer().csv(folder)
    found = text_files.read_texts(spark, folder, ".txt")
    segment = F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1).alias("segment")
    lines = F.sum(F.size(T.split_lines(F.col("text")))).alias("lines")
    return found.groupBy(segment).agg(lines, F.sum(F.length("text")).alias("chars"))


@query
def same_members_docs(spark, sf):
    """Whether the word lengths of a document, modulo 5, are exactly 0 to 2, 3 or 4, by its id."""
    words = F.array_distinct(F.transform(F.split("text", " "), lambda w: F.length(w) % 5))
    needed = F.transform(F.sequence(F.lit(0), F.col("doc_id").cast("int") % 3 + 2), lambda n: n)
    return _documents(spark, sf).select("doc_id", reports.same_members(words, needed).alias("same"))


@query
def line_changes(spark, sf):
    return reports.line_changes(inputs.edited_texts(inputs.table(spark, sf, "orders")))


@query
def tree_kept(spark, sf):
    """Trees are recognised and kept as they are."""
    out = C.compact_documents(
        inputs.trees(inputs.table(spark, sf, "orders")), options=C.Options(threshold=0.1)
    )
    return out.select(
        "doc_id",
        F.get("segments", F.lit(0))["kind"].alias("kind"),
        "output",
        "action",
        F.array_join("explanations", " | ").alias("notes"),
    )


@query
def log_block_form(spark, sf):
    """Logs without a run as record blocks."""
    docs = inputs.order_logs(inputs.table(spark, sf, "orders"))
    return docs.select("doc_id", logs.record_block(F.col("text")).alias("block"))


@query
def confidence_gate(spark, sf):
    out = C.compact_documents(_prompts(spark, sf), options=C.Options(min_confidence=0.78))
    unsure = F.exists("segments", lambda s: s["reason"].eqNullSafe(C.UNSURE))
    return out.select("doc_id", unsure.alias("unsure"))


@query
def unsupported_version(spark, sf):
    out = C.compact_documents(_prompts(spark, sf), options=C.Options(format_version="9"))
    return out.select("doc_id", "output", "action", "reason", F.array_join("explanations", "").alias("notes"))


@query
def user_transformer(spark, sf):
    """A transformer of JSON texts; where it gives NULL the text stays."""
    short = lambda text: F.concat(F.lit("k="), F.get_json_object(text, "$.k"))
    out = C.compact_documents(
        inputs.props_documents(_events(spark, sf)), options=C.Options(transformers={"json": short})
    )
    return out.select("doc_id", "output", "action")


@query
def batch_hooks(spark, sf):
    """Hooks that get all segments of an Arrow batch in one call."""
    words = batch_estimator("words", lambda texts: [len(text.split(",")) for text in texts])
    first = batch_compressor(
        "first",
        lambda texts, kinds: [
            text.split(",")[0] if kind == "json" and "," in text else None for text, kind in zip(texts, kinds)
        ],
    )
    options = C.Options(estimator=words, compressors=(first,))
    out = C.compact_documents(inputs.props_documents(_events(spark, sf)), options=options)
    return out.select("doc_id", "output", "action", "input_tokens", "output_tokens")


# --- streams ---------------------------------------------------------------------------


def _event_stream(spark, sf):
    """Events in one trigger: files of a folder need not follow each other in time."""
    return inputs.table_stream(spark, sf, "events")


@query
def stream_running_metrics(spark, sf):
    events = _event_stream(spark, sf)
    rows = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("tool"),
        (F.col("event_id") % 3 == 0).alias("transformed"),
        F.col("user_id").alias("input_tokens"),
        (F.col("user_id") / 2).cast("long").alias("output_tokens"),
    )
    folder = inputs.scratch(spark, "running-metrics")

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    metrics = stream_metrics.running_metrics(rows)
    started = (
        metrics.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    keys = ["day", "tool"]
    counters = [c for c in metrics.columns if c not in keys]
    latest = [F.max_by(c, "batch").alias(c) for c in counters]
    return spark.read.parquet(f"{folder}/out").groupBy(*keys).agg(*latest)


@query
def stream_compact_prompts(spark, sf):
    source = inputs.table_stream(spark, sf, "conversations")
    folder = inputs.scratch(spark, "compacted")

    def write(out: DataFrame, batch_id: int) -> None:
        kept = out.select("doc_id", "chunk_no", "output", "action", "output_tokens")
        kept.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    stream_chunks.stream_compact(inputs.prompts(source), write, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "output", "action", "output_tokens"
    )


@query
def stream_log_runs(spark, sf):
    folder = inputs.scratch(spark, "runs")
    lines = inputs.log_lines(_event_stream(spark, sf))
    started = (
        stream_runs.collapse_stream(lines, "user_id", "event_id")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    closed = spark.read.parquet(f"{folder}/out")
    return closed.unionByName(stream_runs.open_runs(spark, f"{folder}/checkpoint"))


@query
def stream_live_columns(spark, sf):
    folder = inputs.scratch(spark, "live")
    source = inputs.table_stream(spark, sf, "documents")
    started = (
        stream_chunks.live_columns(source)
        .select("doc_id", "kind", "tokens", "input_hash")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query
def stream_audit_append(spark, sf):
    folder = inputs.scratch(spark, "audit-stream")
    audit_log.append_records(_audit(spark, sf), f"{folder}/in")
    source = stream_metrics.read_audit_stream(spark, f"{folder}/in")
    stream_metrics.append_audit_stream(source, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    copied = audit_log.read_audit(spark, f"{folder}/out")
    return copied.groupBy(F.col("day").cast("string").alias("day"), "tool", "action").agg(
        F.count("*").alias("n"), F.sum("delta_tokens").alias("delta_tokens")
    )


def _recorded_chunks(spark, sf) -> str:
    """Folder of the records and metrics of texts compacted as a stream in chunks of 500."""
    folder = inputs.scratch(spark, "chunk-records")
    texts = inputs.line_texts(inputs.table_stream(spark, sf, "customer"))
    stream_chunks.record_chunks(
        texts, folder, F.col("segment"), F.col("made"), size=500
    ).awaitTermination()
    return folder


@query
def stream_chunk_records(spark, sf):
    """Every chunk of every text is recorded."""
    records = spark.read.parquet(f"{_recorded_chunks(spark, sf)}/chunks")
    return records.select(
        "doc_id",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        "tool",
        "output",
        "action",
        "input_tokens",
        "output_tokens",
    )


@query
def stream_chunk_metrics(spark, sf):
    """The running counters of the same stream: each chunk counts."""
    folder = _recorded_chunks(spark, sf)
    return snapshots.snapshot_rows(snapshots.current_snapshot(spark, f"{folder}/metrics"))
