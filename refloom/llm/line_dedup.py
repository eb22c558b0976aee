"""Line deduplication: documents probe sharded minimal perfect hashes, no line is joined with another.

A line is known by 96 bits of hash of its key. Counting lines gives, per distinct hash, the number of documents that hold it
and the largest id among them. The distinct hashes are dealt to shards of about SHARD_KEYS; each shard numbers its own without a
gap by a minimal perfect hash (levels of bit arrays: a hash is placed on the first level on which it meets no other, its
number is the rank of its bit) and stores arrays along these numbers: fingerprint, count, largest id. Lines then go to their
shard as (hash, place in the document), never as text, and look themselves up in the arrays. A shard with many lines, as one
with a line that a third of the documents share, is probed in pieces of about PIECE_LINES, each with a copy of the small arrays.
What comes back is the places of lines to drop, gathered per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.core import let
from refloom.llm.common import BLANKS, text_of
from refloom.session import materialize

LEAST_LENGTH, LEAST_DOCS = 20, 3
#: Distinct hashes of a shard and lines of a piece, both on average.
SHARD_KEYS, PIECE_LINES = 2048, 8192
#: Bits of a level per hash that is still to be placed.
LOAD = 1.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at either end, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _mixed(h: np.ndarray, f: np.ndarray, level: int) -> np.ndarray:
    """64 bits that depend on hash, fingerprint and level (the finalizer of splitmix64, twice)."""
    x = h.astype(np.int64).view(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for more in (f.astype(np.int64).view(np.uint64), np.uint64(level)):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) + more
    return x


class PerfectHash:
    """Numbers 0 .. n-1 for n distinct (hash, fingerprint) pairs; any other pair gets a number of those or -1."""

    def __init__(self, sizes: list[int], bits: bytes) -> None:
        self.sizes, self.bits = sizes, bits
        self.set = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.set) - 1

    @classmethod
    def of(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h):
            size = int(len(h) * LOAD) + 1
            at = (_mixed(h, f, len(sizes)) % np.uint64(size)).astype(np.int64)
            met = np.bincount(at, minlength=size)
            sizes.append(size)
            levels.append(met == 1)
            left = met[at] > 1
            h, f = h[left], f[left]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(sizes, np.packbits(bits).tobytes())

    def numbers(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        out, todo, start = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = (_mixed(h[todo], f[todo], level) % np.uint64(size)).astype(np.int64) + start
            there = self.set[at]
            out[todo[there]] = self.rank[at[there]]
            todo, start = todo[~there], start + size
        return out


_ARRAYS = "shard long, sizes array<int>, bits binary, prints binary, counts binary, holders binary, unknown binary"


def _index(keys: pa.Table) -> pa.Table:
    """One shard: its perfect hash and the arrays along its numbers."""
    h, f = keys["h"].to_numpy(), keys["f"].to_numpy()
    found = PerfectHash.of(h, f)
    at = found.numbers(h, f)
    unknown = np.asarray(keys["holder"].is_null().combine_chunks())
    arrays = []
    for values, kind in (
        (f, np.int32),
        (keys["docs"].to_numpy(), np.int64),
        (keys["holder"].fill_null(0).to_numpy(), np.int64),
        (unknown, np.uint8),
    ):
        out = np.zeros(len(h), kind)
        out[at] = values
        arrays.append(pa.array([out.tobytes()], pa.binary()))
    sizes = pa.array([found.sizes], pa.list_(pa.int32()))
    names = ["shard", "sizes", "bits", "prints", "counts", "holders", "unknown"]
    return pa.table([keys["shard"].slice(0, 1), sizes, pa.array([found.bits], pa.binary()), *arrays], names)


def _probe(lines: pa.Table, shard: pa.Table, least_docs: int) -> pa.Table:
    """Lines of a piece that are to go: held by enough documents, and this is not the one that keeps them."""
    kept = lines.select(["id", "text_hash", "place"])
    if not lines.num_rows or not shard.num_rows:
        return kept.slice(0, 0)
    own = {c: shard[c][0].as_py() for c in shard.column_names}
    h, f = lines["h"].to_numpy(), lines["f"].to_numpy()
    at = PerfectHash(own["sizes"], own["bits"]).numbers(h, f)
    known = at >= 0
    known &= np.frombuffer(own["prints"], np.int32)[at] == f
    nameless = np.asarray(lines["id"].is_null().combine_chunks())
    ids = lines["id"].fill_null(0).to_numpy()
    no_holder = np.frombuffer(own["unknown"], np.uint8)[at].astype(bool)
    holds = (nameless & no_holder) | (~nameless & ~no_holder & (np.frombuffer(own["holders"], np.int64)[at] == ids))
    gone = known & (np.frombuffer(own["counts"], np.int64)[at] >= least_docs) & ~holds
    return kept.filter(pa.array(gone))


def _lines(rows: DataFrame, least_length: int) -> DataFrame:
    """(id, text_hash, h, f, place, first): the lines that can repeat; first marks one of those equal within the row."""
    keys = F.transform(F.split("text", "\n", -1), line_key)
    keyed = F.transform(keys, lambda k, i: F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("f"), i.alias("place"), F.length(k).alias("n")))
    long = F.sort_array(F.filter(keyed, lambda x: x["n"] >= least_length))
    marked = let(
        long,
        lambda xs: F.transform(
            xs,
            lambda x, i: let(
                F.get(xs, i - 1),
                lambda p: F.struct(
                    x["h"].alias("h"),
                    x["f"].alias("f"),
                    x["place"].alias("place"),
                    F.coalesce((p["h"] != x["h"]) | (p["f"] != x["f"]), F.lit(True)).alias("first"),
                ),
            ),
        ),
    )
    return rows.select("id", "text_hash", F.inline(marked))


def dropped_places(rows: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, text_hash, gone): places of the lines to drop, for the rows (id, text, text_hash) that lose any."""
    lines = materialize(_lines(rows, least_length), "lines")
    counts = lines.groupBy("h", "f").agg(
        F.sum(F.col("first").cast("long")).alias("docs"), F.count("*").alias("lines"), F.max("id").alias("holder")
    )
    counts = materialize(counts, "line-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    shard = F.pmod("h", F.lit(shards).cast("long")).alias("shard")
    keys = counts.select(shard, "h", "f", "docs", "holder")
    arrays = materialize(keys.groupBy("shard").applyInArrow(_index, _ARRAYS), "line-shards")
    # Only shards with more lines than a piece are named here.
    loads = counts.groupBy(shard).agg(F.ceil(F.sum("lines") / F.lit(float(PIECE_LINES))).cast("int").alias("pieces"))
    loads = materialize(loads.where("pieces > 1"), "line-loads")
    pieces = F.coalesce("pieces", F.lit(1))
    probes = lines.select("id", "text_hash", "h", "f", "place", shard).join(loads, "shard", "left")
    piece = F.pmod(F.xxhash64("id", "text_hash", "place"), pieces).cast("int")
    probes = probes.select("id", "text_hash", "h", "f", "place", "shard", piece.alias("piece"))
    copies = arrays.join(loads, "shard", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    hits = probes.groupBy("shard", "piece").cogroup(copies.groupBy("shard", "piece"))
    hits = hits.applyInArrow(lambda a, b: _probe(a, b, least_docs), "id long, text_hash long, place int")
    return hits.groupBy("id", "text_hash").agg(F.collect_set("place").alias("gone"))


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept) per row of docs: kept is the text without the lines that others keep.

    Texts are split at line feeds (null and empty: one empty line). Lines whose key has `least_length` code points or more and is
    held by `least_docs` rows or more go, except in the largest id that holds it, which keeps all of its lines with that key. Every
    row counts as a document, rows that repeat too; rows with the largest id all keep the line. Null ids are below every
    id, and keep a line only if no other row holds it. Ids are integers. A text of any length is read whole in its row. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    gone = dropped_places(rows, least_length, least_docs)
    gone = gone.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "gone")
    full = rows.join(gone, (F.col("text_hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    stays = let(
        F.split("text", "\n", -1),
        lambda xs: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(xs) - 1), F.col("gone")), lambda i: F.get(xs, i)
        ),
    )
    return full.select(
        F.col("id").alias(id_col),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("kept"),
    )
