"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

A leaf is the SHA-256 of a row's columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and
value. Rows of a group are ordered and numbered by ranges and prefix sums; every ``ARITY``
consecutive nodes become the hash of their digests (as hex text), the last run holding
fewer, down to one node, until one node is left: the group's root. The roots, ordered by
group, give the root of all in the same way.

Checkpoint and recompute: of all levels only every ``HEIGHT``-th is stored. ``ARITY ** HEIGHT``
consecutive stored nodes are an aligned subtree; building the next stored level hashes each
such subtree in one task and keeps its top alone. Proofs go down the stored levels: a subtree
is computed again from its stored nodes, each of these gets the siblings on its way up,
followed by those of the subtree's top, and the interior nodes are dropped. So a task
holds one subtree at a time, whatever the size of a group, and no more than one in
``ARITY ** HEIGHT`` rows is ever stored beside the leaves.

* Null values hash as ``-``, which no value does; a row without group is of the group NULL, which
  comes first. Empty texts are ``0:``. Numbers are written in decimal digits, so the columns
  hashed must be whole numbers, texts or booleans.
* Rows of equal order are placed by their leaves; rows equal in all columns hashed are
  interchangeable, and each has a place and proof of its own.
* A group of one row has that leaf as root, one group has its root as the root of all, and a
  proof may be empty. An empty table gives no rows.
* Columns that are not hashed play no part; none but the id comes back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import placed, written

ARITY, HEIGHT = 2, 8
SPAN = ARITY**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row's values as 32 bytes."""

    def item(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(item, values)), 256))


def parent(run: Sequence[bytes]) -> bytes:
    """Digest of the hex text of the digests of a run."""
    return sha256(b"".join(run).hex().encode()).digest()


def levels(nodes: list[bytes], of: int) -> list[list[bytes]]:
    """The nodes of a subtree and all levels above, ``HEIGHT`` at most or up to the group's root.

    ``of`` is the number of nodes of the whole group on the level of ``nodes``.
    """
    out = [nodes]
    while of > 1 and len(out) <= HEIGHT:
        nodes = [parent(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        of = -(-of // ARITY)
        out.append(nodes)
    return out


def siblings(tree: list[list[bytes]], place: int) -> list[bytes]:
    """The other nodes of each run on the way from the node at ``place`` up to the top of ``tree``."""
    found = []
    for nodes in tree[:-1]:
        first = place - place % ARITY
        found += nodes[first:place] + nodes[place + 1 : first + ARITY]
        place //= ARITY
    return found


def folded(node: bytes, place: int, of: int, proof: Iterator[bytes]) -> bytes:
    """The root that ``node``, at ``place`` of ``of``, and the next siblings of ``proof`` give."""
    while of > 1:
        first = place - place % ARITY
        run = [next(proof) for _ in range(min(ARITY, of - first) - 1)]
        run.insert(place - first, node)
        node, place, of = parent(run), place // ARITY, -(-of // ARITY)
    return node


def _subtree() -> Column:
    return F.expr(f"`at` div {SPAN}")


def stored_above(nodes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The stored level above ``nodes`` (keys, at, of, node): the top of every aligned subtree."""
    out = ", ".join([*(f"`{k}` string" for k in keys), "at long", "of long", "node binary"])
    names = [*keys, "at", "of", "node"]

    def top(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        of = rows.column("of")[0].as_py()
        node = levels(rows.column("node").to_pylist(), of)[-1][0]
        values = [*(k.as_py() for k in key), -(-of // SPAN), node]
        return pa.table({n: [v] for n, v in zip(names, values)})

    plain = nodes.select(*keys, "at", "of", "node")
    return written(plain.groupBy(*keys, _subtree().alias("subtree")).applyInArrow(top, out), name)


def climbed(nodes: DataFrame, keys: list[str], name: str) -> list[DataFrame]:
    """``nodes`` and the stored levels above them, up to one root for each of ``keys``."""
    out = [nodes]
    largest = nodes.agg(F.max("of")).first()[0] or 0
    while largest > 1:
        out.append(stored_above(out[-1], keys, name))
        largest = -(-largest // SPAN)
    return out


def descended(stored: list[DataFrame], keys: list[str], paths: DataFrame) -> DataFrame:
    """keys, at, and ``path``: all siblings of each node of the lowest of ``stored``, upward.

    ``paths`` has those of the highest stored nodes.
    """
    out = ", ".join([*(f"`{k}` string" for k in keys), "at long", "path array<binary>"])
    binaries = pa.list_(pa.binary())

    def down(below: pa.Table, above: pa.Table) -> pa.Table:
        below = below.sort_by("at")
        tree = levels(below.column("node").to_pylist(), below.column("of")[0].as_py())
        rest = above.column("path").to_pylist()[0]
        found = [siblings(tree, place) + rest for place in range(below.num_rows)]
        return below.select([*keys, "at"]).append_column("path", pa.array(found, binaries))

    for nodes in reversed(stored[:-1]):
        left = nodes.select(*keys, "at", "of", "node").groupBy(*keys, _subtree().alias("subtree"))
        right = paths.select(*keys, F.col("at").alias("subtree"), "path").groupBy(*keys, "subtree")
        paths = left.cogroup(right).applyInArrow(down, out)
    return paths


@dataclass(frozen=True)
class Manifest:
    """The stored levels, lowest first: of the rows by group, and of the groups' roots.

    The lowest level of ``rows`` has the id and, if given, the digest ``changed`` as well.
    """

    rows: list[DataFrame]
    groups: list[DataFrame]


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    changed: Column | None = None,
) -> Manifest:
    """The trees over all rows of ``docs``, ordered by ``id_col`` within ``group_col``.

    ``changed`` is a further digest of a row, for instance of a copy that is to be checked;
    it is kept beside the leaf (null: unchanged) and plays no part in the trees.
    """
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        # Texts sort as before; the group NULL is "n", before all "s...".
        F.coalesce(F.concat(F.lit("s"), group), F.lit("n")).alias("group"),
        F.col(id_col).alias("id"),
        leaf([F.col(c) for c in columns]).alias("node"),
        (F.lit(None) if changed is None else changed).cast("binary").alias("changed"),
    )
    # Written first: ranges are drawn from a sample, and rows would be hashed twice.
    leaves = written(leaves, "manifest-leaves")
    rows = climbed(placed(leaves, ["group"], ["id", "node"], "manifest"), ["group"], "manifest-level")
    roots = placed(rows[-1].select("group", "node"), [], ["group"], "manifest-roots")
    return Manifest(rows, climbed(roots, [], "manifest-roots-level"))


def proofs(made: Manifest) -> DataFrame:
    """One row for each leaf: id, its places, digests and proof, and what folding it gives.

    leaf, subroot, root and folded_root are digests, proof is an array of them: the siblings from
    the leaf's level up to the root of all. folded_root is computed from ``changed``, or else
    the leaf, and the proof; at and of place the leaf in its group, group_at and group_of the
    group among all.
    """
    spark = made.rows[0].sparkSession
    top = made.groups[-1].select("node").first()  # one digest
    root = F.lit(bytearray(top.node if top else b""))
    begin = spark.createDataFrame([(0, [])], "at long, path array<binary>")
    upper = descended(made.groups, [], begin)
    names = F.struct("at", "of", "node").alias("group_in")
    groups = made.groups[0].select("group", "at", names).join(upper, "at").drop("at")
    groups = written(groups, "manifest-groups")
    paths = descended(made.rows, ["group"], groups.select("group", F.lit(0).cast("long").alias("at"), "path"))
    rows = made.rows[0].join(paths, ["group", "at"]).join(groups.drop("path"), "group")
    rows = rows.select(
        "id",
        "at",
        "of",
        F.col("group_in.at").alias("group_at"),
        F.col("group_in.of").alias("group_of"),
        F.col("node").alias("leaf"),
        F.coalesce("changed", "node").alias("given"),
        F.col("group_in.node").alias("subroot"),
        root.alias("root"),
        F.col("path").alias("proof"),
    )
    return with_folded(rows)


def with_folded(rows: DataFrame) -> DataFrame:
    """``rows`` (given, at, of, group_at, group_of, proof) and the root that each row's proof gives."""
    needed = ("given", "at", "of", "group_at", "group_of", "proof")
    schema = rows.withColumn("folded_root", F.lit(b"")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for given, at, of, group_at, group_of, proof in zip(*(batch[c].to_pylist() for c in needed)):
                rest = iter(proof)
                found.append(folded(folded(given, at, of, rest), group_at, group_of, rest))
            yield batch.append_column("folded_root", pa.array(found, pa.binary()))

    return rows.mapInArrow(fold, schema)


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))
