"""JSON documents to node rows and to compact blocks, at any nesting depth.

A text is cut into tokens inside its row, the tokens become rows, and two
windows give every value its depth, its name and its number of children. All
windows and the final aggregate share the document key, so raw texts are
shuffled once and tokens are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tersely.functions import compact_form as form
from tersely.functions.json_text import atom_value, plain_tokens, resolved, string_value, tokens
from tersely.operators.skew import spread, spread_rows


def _quoted(names: Sequence[str]) -> str:
    return ", ".join(f"`{name}`" for name in names)


def value_rows(token_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of values with depth and child count.

    ``token_rows`` has the keys, ``pos`` and ``t`` (token struct). Rows whose
    token is NULL pass through.
    """
    keys = list(keys)
    by_pos = W.partitionBy(*keys).orderBy("pos")
    tok = F.col("t.tok")
    opens = tok.isin("{", "[").cast("int")
    closes = tok.isin("}", "]").cast("int")
    levelled = token_rows.withColumn(
        "level", F.sum(opens - closes).over(by_pos.rowsBetween(W.unboundedPreceding, 0))
    )
    # A container's commas lie between its two brackets on the same level,
    # and containers of one level follow each other without overlap.
    levelled = levelled.withColumn("inner", F.col("level") + F.coalesce(closes, F.lit(0)))
    by_level = W.partitionBy(*keys, "inner").orderBy("pos")
    comma = (tok == ",").cast("int")
    counted = levelled.withColumn(
        "commas", F.sum(comma).over(by_level.rowsBetween(W.unboundedPreceding, 0))
    )
    counted = counted.withColumn("at_close", F.when(closes == 1, F.col("commas"))).withColumn(
        "at_close",
        F.expr(
            "lead(at_close) IGNORE NULLS OVER "
            f"(PARTITION BY {_quoted(keys)}, `inner` ORDER BY pos)"
        ),
    )
    values = counted.filter(F.coalesce(~tok.isin(",", "}", "]"), F.lit(True)))
    return values.withColumn("depth", F.col("level") - F.coalesce(opens, F.lit(0))).withColumn(
        "children",
        F.when(
            opens == 1,
            F.when(F.col("t.empty"), F.lit(0).cast("long")).otherwise(
                F.col("at_close") - F.col("commas") + 1
            ),
        ),
    )


def value_line(root: str = form.ROOT_NAME) -> Column:
    """Compact line (or lines, for a record list) of one value row."""
    tok, rec, depth = F.col("t.tok"), F.col("t.rec"), F.col("depth")
    item = (depth > 0) & F.col("t.label").isNull()
    name = (
        F.when(depth == 0, F.lit(root))
        .when(item, F.lit("-"))
        .otherwise(string_value(F.col("t.label")))
    )
    head = F.concat(form.indent(depth.cast("int")), name)
    rows = F.transform(
        rec["rows"], lambda r: F.concat(F.lit("\n"), form.indent((depth + 1).cast("int")), r)
    )
    table = F.concat(
        form.table_header(head, rec["count"], rec["keys"]), F.array_join(rows, "")
    )
    return (
        F.when(rec.isNotNull(), table)
        .when(tok == "{", F.concat(head, F.when(item, F.lit("")).otherwise(F.lit(":"))))
        .when(tok == "[", form.list_header(head, F.col("children")))
        .otherwise(
            F.concat(
                head, F.when(item, F.lit(" ")).otherwise(F.lit(": ")), atom_value(tok)
            )
        )
    )


ROW_KEY = ["_key", "_number"]


def numbered(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``documents`` spread by content, each row with a key of its own (``ROW_KEY``).

    Rows are numbered where they arrive, so a repeated task gives the same rows.
    """
    keyed = documents.withColumn("_key", F.xxhash64(id_col, text_col))
    return spread(keyed, "_key").withColumn("_number", F.monotonically_increasing_id())


def _resolved_texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row keys, id and text of each document, no object of which repeats a key.

    Texts are resolved before they are numbered: the windows that follow rely on that shuffle.
    """
    documents = spread_rows(documents, id_col, text_col)
    own = F.get(resolved(F.array(text_col)), F.lit(0))
    rows = documents.select(id_col, F.coalesce(own, text_col).alias(text_col))
    return numbered(rows, id_col, text_col).select(*ROW_KEY, id_col, text_col)


def json_nodes(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per JSON value: position, depth, name, kind and scalar text.

    ``documents`` holds valid JSON texts; each row is a document of its own. Of a
    repeated key the last value counts, at the first one's place.
    """
    rows = _resolved_texts(documents, id_col, text_col).select(
        *ROW_KEY, id_col, F.posexplode(plain_tokens(F.col(text_col))).alias("pos", "t")
    )
    tok = F.col("t.tok")
    kind = (
        F.when(tok == "{", F.lit("object"))
        .when(tok == "[", F.lit("array"))
        .when(F.startswith(tok, F.lit('"')), F.lit("string"))
        .when(tok == "null", F.lit("null"))
        .when(tok.isin("true", "false"), F.lit("boolean"))
        .otherwise(F.lit("number"))
    )
    label = F.col("t.label")
    return value_rows(rows, ROW_KEY).select(
        id_col,
        "pos",
        "depth",
        F.when(label.isNotNull(), string_value(label)).alias("key"),
        kind.alias("kind"),
        F.when(~tok.isin("{", "["), atom_value(tok)).alias("value"),
        "children",
    )


def json_compact(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Compact block per JSON document: ``(id, compact)``."""
    rows = _resolved_texts(documents, id_col, text_col).select(
        *ROW_KEY, id_col, F.posexplode(tokens(F.col(text_col))).alias("pos", "t")
    )
    lines = value_rows(rows, ROW_KEY).select(*ROW_KEY, id_col, "pos", value_line().alias("line"))
    blocks = lines.groupBy(*ROW_KEY).agg(
        F.first(id_col).alias(id_col),
        F.concat(F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY pos)"), F.lit("\n")).alias(
            "compact"
        ),
    )
    return blocks.drop(*ROW_KEY)
