"""Structured inputs derived row by row from the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.functions.text import estimate_tokens
from tersely.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; it may be one file or a folder of files.

    The path is a pattern: without one a file would be taken for a folder of partitions.
    """
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The local fallback serves local sessions that name none, as in tests.
    """
    base = checkpoint_dir(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def level_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "error", "ERROR")
        .when(event_type == "purchase", "WARN")
        .when(event_type == "signup", "DEBUG")
        .otherwise("INFO")
    )


def log_lines(events: DataFrame) -> DataFrame:
    """One log line per event."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    line = F.concat(stamp, F.lit("Z "), level_of(kind), F.lit(" "), kind)
    return events.select("user_id", "event_id", "ts", "event_type", line.alias("line"))


def time_slot(seconds: int = 86_400) -> Column:
    """Slot of time of an event, a day: the bucket hot users are split by."""
    return F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)


def _listed(count: Column, item) -> Column:
    return F.transform(F.sequence(F.lit(0), count - 1), item)


def prompts(conversations: DataFrame) -> DataFrame:
    """One prompt per turn: its text and a block whose form depends on the turn.

    Forms: 0 fenced JSON, 1 fenced log, 2 fenced code, 3 no block, 4 fenced
    YAML, 5 fenced trace without label.
    """
    turn, role, text = F.col("turn").cast("int"), F.col("role"), F.col("text")
    form = ((F.col("conv_id") + F.col("turn")) % 6).cast("int")
    s = lambda i: i.cast("string")
    objects = _listed(
        turn + 2, lambda i: F.concat(F.lit('{"id":'), s(i), F.lit(',"role":"'), role, F.lit('"}'))
    )
    logs = _listed(
        turn + 3,
        lambda i: F.concat(
            F.lit("2024-01-01T00:00:0"), s(i % 10), F.lit("Z ERROR "), role, F.lit(" timeout\n")
        ),
    )
    records = _listed(
        turn + 2, lambda i: F.concat(F.lit("  - id: "), s(i), F.lit("\n    role: "), role, F.lit("\n"))
    )
    frames = _listed(
        turn + 7,
        lambda i: F.concat(F.lit('  File "m'), s(i), F.lit('.py", line '), s(i), F.lit(", in f\n")),
    )
    join = lambda items, sep="": F.array_join(items, sep)
    block = (
        F.when(
            form == 0,
            F.concat(F.lit("\n\n```json\n["), join(objects, ","), F.lit("]\n```\nWhat is wrong?\n")),
        )
        .when(form == 1, F.concat(F.lit("\n\n```log\n"), join(logs), F.lit("```\n")))
        .when(form == 2, F.lit("\n\n```python\nprint(1)\n```\nWhy?\nSay it in short.\n"))
        .when(
            form == 4,
            F.concat(F.lit("\n\n```yaml\nservice: checkout\nitems:\n"), join(records), F.lit("```\n")),
        )
        .when(
            form == 5,
            F.concat(
                F.lit("\n\n```\nTraceback (most recent call last):\n"),
                join(frames),
                F.lit("ValueError: bad\n```\n"),
            ),
        )
        .otherwise(F.lit(""))
    )
    return conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(
            "doc_id"
        ),
        F.concat(text, block).alias("text"),
    )


def order_lists(orders: DataFrame, mixed: bool = False) -> DataFrame:
    """One JSON list of three records per order.

    ``mixed`` varies the last record: one third has other keys, one third a repeated key
    with a subtree each time.
    """
    key = F.col("o_orderkey")
    quoted = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
    record = lambda i: F.concat(
        F.lit('{"id":'),
        (key * 10 + i).cast("string"),
        F.lit(', "status":'),
        quoted(F.col("o_orderstatus")),
        F.lit(',"prio" : '),
        quoted(F.col("o_orderpriority")),
        F.lit("}"),
    )
    other = F.when(key % 3 == 1, F.lit('{"status":"F"}')).when(
        key % 3 == 2, F.lit('{"id":7,"status":{"a":[1]},"prio":null,"status":{"b":[]}}')
    )
    last = F.coalesce(other, record(2)) if mixed else record(2)
    text = F.concat(F.lit("["), F.concat_ws(",", record(0), record(1), last), F.lit("]"))
    return orders.select(key.alias("doc_id"), text.alias("text"))


def delimited_texts(orders: DataFrame) -> DataFrame:
    """A small delimited text per order: comma, tab, or uneven by order key."""
    key = F.col("o_orderkey")
    s = key.cast("string")
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    comma = F.concat(
        F.lit("key,status,prio\n"), s, F.lit(","), status, F.lit(',"'), prio, F.lit(', ""x"""\n')
    )
    tab = F.concat(F.lit("key\tstatus\n"), s, F.lit("\t"), status, F.lit("\n\n"), s, F.lit("\t,\n"))
    uneven = F.concat(F.lit("key,status\n"), s, F.lit(","), status, F.lit(",z\n"))
    text = F.when(key % 3 == 0, comma).when(key % 3 == 1, tab).otherwise(uneven)
    return orders.select(key.alias("doc_id"), text.alias("text"))


def traces(events: DataFrame) -> DataFrame:
    """One stack trace per event, 3 to 14 frames, every third with code lines."""
    key = F.col("event_id")
    s = lambda c: c.cast("string")
    code = F.when(key % 3 == 0, F.lit("    call()\n")).otherwise(F.lit(""))
    frames = F.transform(
        F.sequence(F.lit(1).cast("long"), 3 + key % 12),
        lambda i: F.concat(F.lit('  File "m'), s(i), F.lit('.py", line '), s(i), F.lit(", in f\n"), code),
    )
    text = F.concat(
        F.lit("Traceback (most recent call last):\n"),
        F.array_join(frames, ""),
        F.lit("ValueError: "),
        F.col("event_type"),
    )
    return events.select(key.alias("doc_id"), text.alias("text"))


def env_lines(events: DataFrame) -> DataFrame:
    """An assignment line per event."""
    text = F.concat(
        F.lit("export API_KEY="),
        F.col("user_id").cast("string"),
        F.lit(" MODE='"),
        F.col("event_type"),
        F.lit("' x=1"),
    )
    return events.select("event_id", text.alias("text"))


def props_documents(events: DataFrame) -> DataFrame:
    """A JSON document per event; errors hold a list that gets shorter."""
    item = F.concat(F.lit('{"kind":"'), F.col("event_type"), F.lit('","n":1}'))
    listed = F.concat(F.lit('{"list":['), F.concat_ws(",", item, item, item), F.lit("]}"))
    text = F.when(F.col("event_type") == "error", listed).otherwise(F.col("props"))
    return events.select(F.col("event_id").alias("doc_id"), text.alias("text"))


def results(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Result rows: every second document with newlines taken out."""
    day = events.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    short = F.when(
        F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    ).otherwise(F.col("text"))
    sized = documents.select(
        "doc_id",
        "lang",
        "source",
        "text",
        estimate_tokens(F.col("text")).alias("input_tokens"),
        estimate_tokens(short).alias("output_tokens"),
        F.when(F.col("source") == "src3", F.lit("  ")).otherwise(F.col("source")).alias("tool"),
    ).withColumn("transformed", F.col("output_tokens") < F.col("input_tokens"))
    reason = (
        F.when(F.col("transformed"), "ok")
        .when(F.col("doc_id") % 2 == 0, "rewrite did not reduce estimated tokens")
        .otherwise("input exceeds max_input_bytes")
    )
    return sized.withColumn("reason", reason).join(day, "doc_id")


def line_texts(customers: DataFrame) -> DataFrame:
    """A text of 30, 40 or 50 equal lines of 25 characters per customer; one in four is prose."""
    key = F.col("c_custkey")
    line = F.when(key % 4 == 0, F.lit("just some plain old word\n")).otherwise(
        F.concat(F.lit("ERROR order "), F.substring("c_mktsegment", 1, 1), F.lit(" is delayed\n"))
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 3).cast("int"))
    return customers.select(
        key.alias("doc_id"),
        F.col("c_mktsegment").alias("segment"),
        day.cast("timestamp").alias("made"),
        F.repeat(line, (key % 3 * 10 + 30).cast("int")).alias("text"),
    )


def edited_texts(orders: DataFrame) -> DataFrame:
    """Six lines per order, and the same with one of them left out and one put in after the third."""
    key = F.col("o_orderkey")
    dropped = (key % 6 + 1).cast("int")
    line = lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of "), key.cast("string"))
    numbers = F.sequence(F.lit(1), F.lit(6))
    after = F.flatten(
        F.transform(
            numbers,
            lambda i: F.concat(
                F.when(i == dropped, F.array().cast("array<string>")).otherwise(F.array(line(i))),
                F.when(i == 3, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")),
            ),
        )
    )
    return orders.select(
        key.alias("doc_id"),
        F.array_join(F.transform(numbers, line), "\n").alias("text"),
        F.array_join(after, "\n").alias("output"),
    )


def trees(orders: DataFrame) -> DataFrame:
    """A text per order that names a list as a tree does; one in three has too few lines for one."""
    key = F.col("o_orderkey")
    tree = F.concat(
        F.lit("orders[2]:\n  id: "), key.cast("string"), F.lit("\n  status: "), F.col("o_orderstatus"), F.lit("\n")
    )
    short = F.concat(F.lit("orders[2]: of key "), key.cast("string"), F.lit(" without more to it\n"))
    return orders.select(key.alias("doc_id"), F.when(key % 3 == 0, short).otherwise(tree).alias("text"))


def order_logs(orders: DataFrame) -> DataFrame:
    """Log texts without a run: two lines with level, two without, or one of each, by order key."""
    key = F.col("o_orderkey")
    first = F.concat(F.lit("2024-01-01T00:00:00Z ERROR order "), key.cast("string"), F.lit(" late\n"))
    second = F.concat(F.lit("2024-01-01T00:00:01Z WARN prio, "), F.col("o_orderpriority"), F.lit("\n"))
    bare = F.concat(F.lit("status "), F.col("o_orderstatus"), F.lit("\n"))
    text = F.when(key % 3 == 0, F.concat(first, second)).when(key % 3 == 1, F.concat(bare, bare))
    return orders.select(key.alias("doc_id"), text.otherwise(F.concat(first, bare)).alias("text"))
