"""Pack table rows into compact record blocks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tersely.functions import compact_form as form
from tersely.functions.json_text import RECORD_LIST, record_lists
from tersely.functions.text import let


def _row_text(cols: Sequence[str]) -> Column:
    return form.row(F.array(*[form.cell(F.col(c)) for c in cols]))


def _header(name: str, count: Column, cols: Sequence[str]) -> Column:
    return form.table_header(name, count, F.array(*[F.lit(c) for c in cols]))


def pack_records(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    name: str = form.ROOT_NAME,
    bucket: Column | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Compact blocks of each key's rows: ``(keys, block_no, n, block)``.

    Each block carries its own header, no row is left out, and a block is one string.
    Without ``rows_per_block`` there is one block a key (``block_no`` 0), or one for each
    ``bucket`` (``block_no`` is the bucket). With it, blocks hold that many rows in order, the
    last one fewer, numbered from 0; ``bucket``, a whole number that grows with the order,
    then only deals the work and changes nothing in the result. ``order`` must order the
    rows of a key totally.
    """
    keys = list(keys)
    places = [f"_o{n}" for n in range(len(order))]
    rows = df.select(
        *keys,
        (F.lit(0) if bucket is None else bucket).cast("long").alias("block_no"),
        *[F.col(c).alias(o) for c, o in zip(order, places)],
        F.concat(form.indent(1), _row_text(cols)).alias("_row"),
    )
    if rows_per_block is not None:
        if rows_per_block < 1:
            raise ValueError("rows_per_block must be 1 or more")
        rows = _row_numbers(rows, keys, "block_no", places)
        rows = rows.withColumn("block_no", F.expr(f"(_at - 1) div {rows_per_block}"))
    packed = rows.groupBy(*keys, "block_no").agg(
        F.count("*").alias("n"),
        F.expr(rf"listagg(_row, '\n') WITHIN GROUP (ORDER BY {', '.join(places)})").alias("_body"),
    )
    return packed.select(
        *keys,
        "block_no",
        "n",
        F.concat(_header(name, F.col("n"), cols), F.lit("\n"), F.col("_body"), F.lit("\n")).alias(
            "block"
        ),
    )


def _row_numbers(df: DataFrame, keys: list[str], bucket: str, places: list[str]) -> DataFrame:
    """``df`` with ``_at``, a row's number from 1 in its key: prefix sums of counts, plus its own in its bucket.

    A task holds the rows of a bucket, and one count for each bucket of a key.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("_size"))
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(
        *[F.col(c).alias(f"_k{n}") for n, c in enumerate([*keys, bucket])],
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"),
    )
    inside = W.partitionBy(*keys, bucket).orderBy(*places)
    numbered = df.withColumn("_in_bucket", F.row_number().over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate([*keys, bucket])]
    joined = numbered.join(bases, reduce(and_, same))
    return joined.withColumn("_at", F.col("_base") + F.col("_in_bucket")).select(*df.columns, "_at")


def pack_lines(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    name: str = form.ROOT_NAME,
) -> DataFrame:
    """The same blocks as rows of lines, for groups of any size.

    ``part`` is 0 for a header and 1 for a record; sorted by keys, ``part``
    and ``order`` the lines read as the blocks. Records are not shuffled.
    """
    keys, order = list(keys), list(order)
    heads = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    types = dict(df.dtypes)
    heads = heads.select(
        *keys,
        F.lit(0).alias("part"),
        *[F.lit(None).cast(types[c]).alias(c) for c in order],
        _header(name, F.col("_n"), cols).alias("line"),
    )
    rows = df.select(
        *keys, F.lit(1).alias("part"), *order, F.concat(form.indent(1), _row_text(cols)).alias("line")
    )
    return heads.unionByName(rows)


def is_record_list(text: Column) -> Column:
    """True for a JSON list of flat objects with equal keys in equal order."""
    return F.when(
        text.rlike(rf"^\s*+{RECORD_LIST}\s*+$"), let(text, record_lists).isNotNull()
    ).otherwise(F.lit(False))
