"""What several operators share: words, the null rule for texts, and connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.session import materialize

#: ASCII white space as the contracts name it: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: As a Java pattern.
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; the empty array if there is none."""
    parts = F.split(text, BLANK_CLASS + "+")
    # Only a blank at either end of the text gives an empty part.
    return F.filter(parts, lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, without an array kept for it: blanks at the ends give an empty part each."""
    parts = F.split(text, BLANK_CLASS + "+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For the nodes 0..n-1 under the edges (a, b): the smallest node each reaches, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the undirected edges (a, b): root is the smallest node that node reaches.

    Alternating large and small stars: every round hangs the neighbours of a node on its smallest neighbour, until
    all edges point to the root. A round is two aggregations, which combine before the shuffle, and two joins against one
    row per node, whose many-rowed side Spark can split. Rounds grow with the logarithm of the longest path; each is
    written to the shared folder, so no lineage piles up and a lost executor costs one round. Nodes are of any
    ordered type. Loops and repeated edges are dropped; no edge gives no row.
    """
    stars = materialize(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: the larger neighbours of each node go to the smallest of all.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        stars = materialize(small, "edges")
