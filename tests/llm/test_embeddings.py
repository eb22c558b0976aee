"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from refloom.llm import embeddings, queries


def brute(rows):
    """rows of (id, vector, label) -> {place: (links, component)}; components by depth-first search."""
    fit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fit[k] = np.array(v, np.float64)
    near = {k: [] for k in range(len(rows))}
    for i in fit:
        for j in fit:
            if i != j and rows[i][2] == rows[j][2] and len(fit[i]) == len(fit[j]):
                a, b = fit[i], fit[j]
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    near[i].append(j)
    out = {}
    for k in near:
        if k not in out:
            group, stack = set(), [k]
            while stack:
                if (x := stack.pop()) not in group:
                    group.add(x)
                    stack += near[x]
            ids = [rows[x][0] for x in group if rows[x][0] is not None]
            out |= {x: (len(near[x]), min(ids) if ids else None) for x in group}
    return out


def answer(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def expected(rows):
    return sorted((str(rows[k][0]), n, str(c), rows[k][0] == c) for k, (n, c) in brute(rows).items())


def clustered(n=500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    rows = []
    for k in range(n):
        v = centres[k % 8] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.2, 1.0])
        rows.append((k, [float(np.float32(x)) for x in v], k % 3))
    return rows


@pytest.mark.parametrize("window", [1024, 16])
def test_all_pairs_are_found(spark, window):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert answer(embeddings.near_duplicates(df, window=window)) == expected(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, -0.0], 1),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1), (12, [1.0, 0.0], 2),
        (13, [1e-30, 0.0], 1), (14, [3e38, 0.0], 1), (15, [-1.0, 0.0], 1), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rid", F.lit("x"))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], t) for i, v, t in rows]
    got, want = answer(embeddings.near_duplicates(df)), expected(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert answer(queries.op10_embedding_dedup(spark, sf)) == expected(rows)


def test_passes_grow_with_the_signs():
    counts = [embeddings.passes_for(b) for b in range(12)]
    assert counts[0] == 1 and counts == sorted(counts)
