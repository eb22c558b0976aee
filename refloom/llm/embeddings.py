"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector a string of random hashes (signs of random projections) and orders the vectors of a label by
it, lexicographically. Vectors at a small angle mostly agree in the leading signs, so they land close together: the
neighbourhood compared is the run that agrees in the first b signs, with b such that a run has about `window` vectors.
Runs that are longer, as those of a large group of near copies, are cut into windows, and every window meets every other
of its run, each meeting being a task of its own; so no vector has a limit on its links. The number of passes follows
from b, so that a pair exactly at the threshold is missed by all passes with a probability of `miss` at most. Pairs are
verified in double precision, each in the first pass that brings it together. Equal vectors are compared once, with
their number as weight. Tasks return one row per linked vector (number of links, root within the task), never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from refloom.llm.common import components, local_roots
from refloom.session import materialize

THRESHOLD, WINDOW, MISS, SEED = 0.98, 1024, 1e-6, 11
#: Signs per pass at most, and rows of a block of the similarity matrix.
MOST_BITS, BLOCK = 30, 1024
_RUN = ["pass", "label", "dim", "prefix"]


def passes_for(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold was apart in the first `bits` signs of all with at most `miss`."""
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if together >= 1 else math.ceil(math.log(miss) / math.log(1 - together))


def prefixes(vectors: np.ndarray, bits: int, count: int, seed: int = SEED) -> np.ndarray:
    """The first `bits` signs of each of `count` passes, as integers: one row per vector, one column per pass."""
    out = np.zeros((len(vectors), count), np.int32)
    for p in range(count):
        planes = np.random.default_rng([seed, p, vectors.shape[1]]).standard_normal((MOST_BITS, vectors.shape[1]))
        signs = vectors @ planes[:bits].T > 0
        out[:, p] = signs @ (1 << np.arange(bits)[::-1]) if bits else 0
    return out


def _emit(frames: Iterator[pd.DataFrame], kind: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for (dim, bits, count), rows in frame.groupby(["dim", "bits", "passes"]):
            raw = np.stack(rows["vec"].to_list()).astype(kind)
            keys = prefixes(raw.astype(np.float64), int(bits), int(count))
            vec, all_keys = [r.tobytes() for r in raw], [k.tobytes() for k in keys]
            for p in range(int(count)):
                yield pd.DataFrame(
                    {
                        "pass": p,
                        "label": rows["label"].to_numpy(),
                        "dim": dim,
                        "prefix": keys[:, p],
                        "rid": rows["rid"].to_numpy(),
                        "n": rows["n"].to_numpy(),
                        "keys": all_keys,
                        "vec": vec,
                    }
                )


def _meet(rows: pd.DataFrame, kind: str, threshold: float) -> pd.DataFrame:
    """Links between (or within) the two windows of a meeting: per linked vector its weighted links and local root."""
    rows = rows.sort_values(["keys", "rid"], ignore_index=True)
    now = int(rows["pass"].iloc[0])
    x = np.frombuffer(b"".join(rows["vec"]), kind).reshape(len(rows), -1).astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    keys = np.frombuffer(b"".join(rows["keys"]), np.int32).reshape(len(rows), -1)[:, :now]
    weight, rid, window = rows["n"].to_numpy(), rows["rid"].to_numpy(), rows["window"].to_numpy()
    within = rows["lo"].iloc[0] == rows["hi"].iloc[0]
    count, a, b = np.zeros(len(rows), np.int64), [], []
    for i in range(0, len(rows), BLOCK):
        for j in range(i, len(rows), BLOCK):
            cos = (x[i : i + BLOCK] @ x[j : j + BLOCK].T) / np.outer(norm[i : i + BLOCK], norm[j : j + BLOCK])
            u, v = np.nonzero(cos >= threshold)
            u, v = u + i, v + j
            new = (u < v) if within else (u < v) & (window[u] != window[v])
            u, v = u[new], v[new]
            # A pair that an earlier pass has brought together is counted there.
            new = ~(keys[u] == keys[v]).any(axis=1)
            u, v = u[new], v[new]
            np.add.at(count, u, weight[v])
            np.add.at(count, v, weight[u])
            # A tree of these links is enough for the components.
            root = local_roots(len(rows), u, v)
            tree = np.flatnonzero(root != np.arange(len(rows)))
            a.append(tree)
            b.append(root[tree])
    root = local_roots(len(rows), np.concatenate(a), np.concatenate(b))
    at = np.flatnonzero(count)
    return pd.DataFrame({"rid": rid[at], "root": rid[root[at]], "links": count[at]})


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    window: int = WINDOW,
    miss: float = MISS,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row: other rows linked directly, smallest id reachable, whether it is the own.

    Rows link if their labels are equal and not null, their vectors have the same length and a cosine of `threshold` or
    more. Vectors that are null, empty, all zero, or hold null, NaN or infinite components link with nothing and are kept.
    Repeated rows link with each other as other rows do; null ids count for no component's smallest id; a cosine equal to
    the threshold links. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    field = vectors.schema[vector_col].dataType
    single = isinstance(field, ArrayType) and isinstance(field.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    vec = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = F.coalesce(finite & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = rows.withColumn("fit", fit)
    reps = rows.where("fit").groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("size"))
    bits = F.greatest(F.lit(0), F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.col("size") / window)))).cast("int")
    table = F.array(*[F.lit(passes_for(k, threshold, miss)) for k in range(MOST_BITS + 1)])
    sizes = sizes.withColumn("bits", bits).withColumn("passes", F.get(table, F.col("bits"))).drop("size")
    dealt = reps.join(sizes, ["label", "dim"]).select("rid", "label", "dim", "bits", "passes", "n", "vec")
    dealt = dealt.mapInPandas(
        lambda frames: _emit(frames, kind),
        "pass int, label string, dim int, prefix int, rid long, n long, keys binary, vec binary",
    )
    dealt = materialize(dealt, "passes")
    runs = dealt.groupBy(*_RUN).agg(F.ceil(F.count("*") / F.lit(2.0 * window)).cast("int").alias("windows"))
    dealt = dealt.join(runs, _RUN).withColumn("window", F.pmod(F.xxhash64("rid"), F.col("windows")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    dealt = dealt.withColumn("lo", F.least("window", "other")).withColumn("hi", F.greatest("window", "other"))
    dealt = dealt.drop("windows", "other")
    found = dealt.groupBy(*_RUN, "lo", "hi").applyInPandas(
        lambda rows: _meet(rows, kind, threshold), "rid long, root long, links long"
    )
    found = materialize(found, "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    named = reps.select("rid", "label", "vec", "n", "least").join(links, "rid", "left")
    named = named.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component", F.lit(True).alias("fit")
    )
    out = rows.join(named, ["label", "vec", "fit"], "left")
    component = F.when(F.col("fit"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
