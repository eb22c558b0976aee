"""SimHash near-duplicates by meeting in the middle.

Two fingerprints differ in at most 2r bits exactly if some 64-bit value lies within r bits of both. Every fingerprint
therefore emits all values within r = 2 bits of itself (2 081 variants), and fingerprints that emit the same variant
link. Shuffling each variant on its own would move some 30 kB per document, so the shuffle goes by the leading bits of
the variants: a fingerprint is sent once to every prefix that any of its variants has (1 + b + b(b-1)/2 rows for b
leading bits), and the task that owns the prefix expands just the variants with this prefix. Each variant is expanded
in exactly one place. b follows from the number of fingerprints, so a task's share stays the same at every size. Where
many fingerprints crowd on a prefix, it is cut by the next bits of the variants, and again, until no task has too much.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from refloom.llm.common import components, local_roots
from refloom.session import materialize

BITS, SEED, SHINGLE = 64, 42, 4
RADIUS = 2
#: Variants that a task holds on average at most, about 30 bytes each.
TASK_VARIANTS = 2_000_000
#: Times that many are a crowd, which is cut. Well above 1, as shares differ: else growing tables would cut half of all prefixes.
CROWD = 4
#: Bits by which a crowded prefix grows at a time.
STEP_BITS = 6
_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint: bit i is set if more than half of the shingles' hashes have it.

    Shingles are slices of the words joined by one blank, repeats included; fewer words than `width` make one shingle.
    No words give 0.
    """
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z is lowered, only ASCII blanks split
    if not words:
        return 0
    width = min(width, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest, n = xxhash.xxh64_digest, len(starts)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, _AT_ONCE):
        some = zip(starts[k : k + _AT_ONCE].tolist(), ends[k : k + _AT_ONCE].tolist(), strict=True)
        raw = np.frombuffer(b"".join([digest(line[s:e], SEED) for s, e in some]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


@pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64), dtype="int64")


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column as a signed long (null texts: 0)."""
    return _fingerprints(text)


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _masks(bits: int, most: int) -> np.ndarray:
    """All values with at most `most` of the lowest `bits` bits set."""
    return np.array(
        [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], dtype=np.uint64
    )


def _meet(rows: pd.DataFrame, low_bits: int, radius: int) -> pd.DataFrame:
    """Links among the fingerprints that share a variant with this prefix, as stars of their components."""
    low = rows["fp"].to_numpy().view(np.uint64) & np.uint64((1 << low_bits) - 1)
    away = rows["away"].to_numpy()
    variants, owners = [], []
    for k in range(radius + 1):
        masks, at = _masks(low_bits, radius - k), np.flatnonzero(away == k)
        variants.append((low[at][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(at.astype(np.int32), len(masks)))
    values, who = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    same = np.flatnonzero(values[1:] == values[:-1])
    n = len(rows)
    pairs = np.unique(who[same].astype(np.int64) * n + who[same + 1])
    a, b = pairs // n, pairs % n
    fp = rows["fp"].to_numpy()
    near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= 2 * radius
    root = local_roots(n, a[near], b[near])
    linked = np.flatnonzero(root != np.arange(n))
    return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})


def _meeting(low_bits: int, radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _meet(rows, low_bits, radius)


def _sent(rows: DataFrame, known: int, bits: int, radius: int) -> DataFrame:
    """(fp, prefix, away): rows to every prefix of `known + bits` bits that a variant with their present prefix can have.

    rows: (fp, prefix, away), where prefix holds the first `known` bits of the variants and away counts where it differs from
    the fingerprint. Only as many further bits may differ as the radius leaves.
    """
    low = BITS - known - bits
    # One constant list of flips for each number of bits that may still differ.
    allowed = [F.array(*[F.lit(int(m)).cast("long") for m in _masks(bits, radius - k)]) for k in range(radius + 1)]
    flips = allowed[0]
    if known:
        for k in range(1, radius + 1):
            flips = F.when(F.col("away") == k, allowed[k]).otherwise(flips)
    own = F.shiftrightunsigned("fp", low) if low else F.col("fp")
    part = own.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    sent = rows.select("fp", "prefix", "away", part.alias("part"), F.explode(flips).alias("flip"))
    prefix = F.shiftleft("prefix", bits).bitwiseOR(F.col("part").bitwiseXOR(F.col("flip")))
    return sent.select("fp", prefix.alias("prefix"), (F.col("away") + F.bit_count("flip")).cast("int").alias("away"))


def links(fingerprints: DataFrame, radius: int = RADIUS, task_variants: int = TASK_VARIANTS) -> DataFrame:
    """Edges (a, b) that connect all values of the column `fp` which differ in at most 2 * radius bits.

    Within a task the links found are reduced to stars of their components; nothing between different values is lost. Prefixes under
    which more than `task_variants` variants stand are cut by the next bits of the variants, and again, until none is
    crowded: a row goes on to those longer prefixes only that a variant of it has, so rows are divided with the variants.
    """
    fps = materialize(fingerprints.select("fp").distinct(), "fingerprints")
    count, ball = fps.count(), sum(math.comb(BITS, k) for k in range(radius + 1))
    bits = max(0, math.ceil(math.log2(max(1, count * ball) / task_variants)))
    rows = fps.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("away"))
    known, found = 0, []
    while True:
        if bits:
            rows = _sent(rows, known, bits, radius)
        known += bits
        low = BITS - known
        cost = F.element_at(F.array(*[F.lit(len(_masks(low, radius - k))) for k in range(radius + 1)]), F.col("away") + 1)
        crowded = rows.groupBy("prefix").agg(F.sum(cost.cast("long")).alias("variants")).where(F.col("variants") > CROWD * task_variants)
        crowded = materialize(crowded.select("prefix"), "crowded")
        # With all bits known a prefix is one variant, and no more fingerprints have it than it has variants itself.
        last = low == 0 or crowded.isEmpty()
        calm = rows if last else rows.join(crowded, "prefix", "left_anti")
        meet = calm.groupBy("prefix").applyInPandas(_meeting(low, radius), "a long, b long")
        found.append(meet if last and not found else materialize(meet, "links"))
        if last:
            return reduce(DataFrame.unionByName, found)
        rows = materialize(rows.join(crowded, "prefix", "left_semi"), "crowd")
        bits = min(STEP_BITS, BITS - known)


def _roots(prints: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint; those without links are their own root."""
    roots = components(links(prints))
    fps = prints.select("fp").distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return fps.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id reachable over fingerprints within 4 bits.

    A null or empty text has fingerprint 0 and is linked like any other. Rows that repeat keep a row each; a null id stays
    null and counts for no component's smallest id. Texts of any length are read whole, their hashes some at a time. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    prints = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "simhash")
    smallest = prints.groupBy("fp").agg(F.min("id").alias("least")).join(_roots(prints), "fp")
    groups = smallest.groupBy("root").agg(F.min("least").alias("component_id"))
    named = smallest.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs per component, the one with the smallest id (a null id last; of rows that repeat any one).

    An empty table gives no rows; null and empty texts are one component. The rows are written once with a number each, and only numbers and fingerprints take part in the grouping.
    """
    row = F.struct(*[F.col(c) for c in docs.columns])
    full = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("place"), fingerprint(F.col(text_col)).alias("fp"))
    full = materialize(full, "simhash")
    prints = full.select(F.col("row").getField(id_col).alias("id"), "place", "fp")
    first = F.struct(F.col("id").isNull().alias("unknown"), "id", "place")
    least = prints.groupBy("fp").agg(F.min(first).alias("first")).join(_roots(prints), "fp")
    chosen = least.groupBy("root").agg(F.min("first").alias("first")).select("first.place")
    return full.join(chosen, "place", "left_semi").select("row.*")
