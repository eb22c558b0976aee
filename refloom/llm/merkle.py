"""Merkle manifest of a data set, with inclusion proofs by checkpoint and recompute.

Every row is a leaf, the leaves of a group (here a language) form a binary tree in the order of their ids, and the roots of
the groups form one more tree whose root stands for the data set. Only every `STRIDE`-th level of a tree is written:
from level k to k + STRIDE a task takes the aligned block of 2 ** STRIDE nodes below one node, hashes its way up and writes
that node alone. Proofs go down the same way: a block is read once more together with the one row of the node above it, its
missing interior nodes are computed anew, each leaf of the block gets its siblings, and the interior is forgotten.
So storage is one level in 2 ** STRIDE, a task holds one block, and no level is gathered in one place.
Ranks come from a range partition over (group, id, leaf, number of the row) and counts per partition, so a group with most of
the rows is spread over as many tasks as any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from refloom.session import materialize

#: Levels between two stored ones; a block has 2 ** STRIDE nodes.
STRIDE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def leaf_of(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields: `-` for a null, otherwise number of UTF-8 bytes, a colon and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """Text that sorts like the group bytewise, null first and apart from every text."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def _hash(run: str) -> str:
    return sha256(run.encode()).hexdigest()


def _up(nodes: list[str]) -> list[str]:
    """The level above: every two consecutive nodes become their hash, a lone last one its own."""
    return [_hash("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def _rounds(size: int) -> int:
    """Levels that a stride climbs in a tree that has `size` nodes on its lower level."""
    return min(STRIDE, (size - 1).bit_length())


def _climb(block: pa.Table) -> pa.Table:
    """The node above an aligned block. Rows: tree, block, pos, node, size."""
    size = block["size"][0].as_py()
    rounds = _rounds(size)
    nodes = block["node"].take(pa.array(np.argsort(block["pos"].to_numpy()))).to_pylist()
    for _ in range(rounds):
        nodes = _up(nodes)
    return pa.table(
        {
            "tree": block["tree"].slice(0, 1),
            "pos": block["block"].slice(0, 1),
            "node": pa.array(nodes, pa.string()),
            "size": pa.array([-(-size >> rounds)], pa.int64()),
        }
    )


def _siblings(block: pa.Table, above: pa.Table, carried: Sequence[str]) -> pa.Table:
    """The rows of a block with their whole path: own siblings, regenerated here, then the path of the node above."""
    order = pa.array(np.argsort(block["pos"].to_numpy()))
    block = block.take(order)
    nodes = block["node"].to_pylist()
    paths: list[list[str]] = [[] for _ in nodes]
    for level in range(_rounds(block["size"][0].as_py())):
        for i, path in enumerate(paths):
            at = (i >> level) ^ 1
            path.append(("LR"[at & 1] + nodes[at]) if at < len(nodes) else "")
        nodes = _up(nodes)
    rest = above["path"][0].as_py()
    out = block.drop_columns(["block"]).append_column("path", pa.array([p + rest for p in paths], pa.list_(pa.string())))
    for name in carried:
        out = out.append_column(name, pa.array([above[name][0].as_py()] * len(paths), pa.string()))
    return out


def in_order(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos (rank from 0 within `tree`, along `order`) and size (rows of the tree). `order` must leave no ties."""
    along = ["tree", *order]
    placed = rows.repartitionByRange(*along).sortWithinPartitions(*along)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    runs = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    runs = runs.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    runs = materialize(runs, "merkle-runs")
    return placed.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _blocks(level: DataFrame) -> DataFrame:
    return level.withColumn("block", F.shiftright("pos", STRIDE))


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels 0, STRIDE, 2 * STRIDE, ... up to the roots, each a written table (tree, pos, node, size).

    leaves: (tree, pos, node, size) and any other columns, which stay on level 0 only.
    """
    levels = [leaves]
    most = leaves.agg(F.max("size")).first()[0] or 1
    while most > 1:
        below = _blocks(levels[-1]).select("tree", "block", "pos", "node", "size")
        top = below.groupBy("tree", "block").applyInArrow(_climb, "tree string, pos long, node string, size long")
        levels.append(materialize(top, "merkle-level"))
        most = -(-most >> STRIDE)
    return levels


def paths(levels: Sequence[DataFrame], roots: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Level 0 with `path`: siblings from the leaf up, each `L` or `R` (its side) and the node; empty where there is none.

    roots: (tree, path, carried...), the path above each root and what its leaves are to carry along.
    """
    above = roots.withColumn("pos", F.lit(0).cast("long"))
    for k in range(len(levels) - 2, -1, -1):
        below = _blocks(levels[k] if k == 0 else levels[k].select("tree", "pos", "node", "size"))
        schema = StructType([f for f in below.schema if f.name != "block"])
        schema = StructType([*schema, StructField("path", ArrayType(StringType())), *[StructField(c, StringType()) for c in carried]])
        parents = above.select("tree", F.col("pos").alias("block"), "path", *carried)
        both = below.groupBy("tree", "block").cogroup(parents.groupBy("tree", "block"))
        above = both.applyInArrow(lambda block, node: _siblings(block, node, carried), schema)
        if k:
            above = materialize(above, "merkle-paths")
    if len(levels) == 1:  # every tree is a lone leaf
        return levels[0].join(roots, "tree")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf and its path."""
    return F.aggregate(
        path,
        leaf,
        lambda node, s: F.sha2(
            F.when(s.startswith("L"), F.concat(F.substring(s, 2, 64), node)).otherwise(F.concat(node, F.substring(s, 2, 64))), 256
        ),
    )


def siblings_hash(path: Column) -> Column:
    """SHA-256 of the siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), ""), 256)


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    claimed: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, leaf, claimed_leaf, subroot, root, path) per row of docs.

    leaf hashes `fields`; claimed_leaf hashes the same fields with those in `claimed` replaced, for a check of contents that
    may have been changed: `fold(claimed_leaf, path)` equals root exactly if nothing was. Groups and ids may be null (first in
    their order, a null group is a group of its own), rows with one id are ordered by their leaf, and rows that are equal in all
    fields are leaves of their own. Null fields count apart from empty ones. Texts of any length are hashed in their row. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    claimed = claimed or {}
    rows = docs.select(
        group_key(F.col(group_col)).alias("tree"),
        F.col(id_col).alias("_id"),
        leaf_of(*[F.col(c) for c in fields]).alias("node"),
        leaf_of(*[claimed.get(c, F.col(c)) for c in fields]).alias("_claimed"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "merkle-leaves")
    levels = stored_levels(in_order(rows, ["_id", "node", "_row"]).drop("_row"))
    # The tree over the groups: their roots are its leaves.
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_tree"), "node")
    top = stored_levels(in_order(subroots, ["_tree"]))
    none = F.array().cast("array<string>")
    summit = top[-1].select("tree", none.alias("path"), F.col("node").alias("root"))
    groups = paths(top, summit, ["root"])
    groups = groups.select(F.col("_tree").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    found = paths(levels, materialize(groups, "merkle-groups"), ["subroot", "root"])
    return found.select(
        F.col("_id").alias(id_col), F.col("node").alias("leaf"), F.col("_claimed").alias("claimed_leaf"), "subroot", "root", "path"
    )
