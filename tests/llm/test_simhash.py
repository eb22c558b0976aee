"""SimHash groups against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from refloom.llm import queries, simhash
from refloom.llm.common import components


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(x) for x in range(len(prints))]


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = [plain_print(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, groups(prints), strict=True)}
    rows = queries.op2_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want and len(rows) == len(ids)


@pytest.mark.parametrize("task_variants", [2_000_000, 20_000])
def test_links_lose_no_pair(spark, task_variants):
    """Chains and crowds of fingerprints, with many prefixes and with crowded ones that are cut again."""
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        v = rng.choice(values[:8] + values[-20:])
        for b in rng.sample(range(64), rng.randrange(1, 8)):
            v ^= 1 << b
        values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, task_variants=task_variants)).collect()}
    root = groups(values)
    for i in range(len(values)):
        for j in range(i):
            same = got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])
            assert same == (root[i] == root[j])


def test_a_crowd_under_one_prefix_is_divided(spark):
    """Fingerprints with 20 leading bits in common: links as by all pairs, and rows that are divided with the prefixes."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**44, 3000, np.uint64) | np.uint64(0xABCDE << 44)
    near = values[:500] ^ (np.uint64(1) << rng.integers(0, 44, 500).astype(np.uint64)) ^ np.uint64(5)
    values = np.unique(np.concatenate((values, near)))
    fps = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "fp long")
    got = {r.node: r.root for r in components(simhash.links(fps, task_variants=100_000)).collect()}
    a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4, 1))
    root = simhash.local_roots(len(values), a, b)
    signed = values.view(np.int64).tolist()
    assert {i for i in range(len(values)) if (root == root[i]).sum() > 1} == {i for i, v in enumerate(signed) if v in got}
    assert len({got[signed[i]] for i in a}) == len(set(root[a]))
    assert all(got[signed[i]] == got[signed[j]] for i, j in zip(a, b, strict=True))
    start = fps.select("fp", F.shiftrightunsigned("fp", 44).alias("prefix"), F.lit(0).alias("away"))
    sent = simhash._sent(start, 20, 6, 2).groupBy("prefix").count()
    assert sent.agg(F.max("count")).first()[0] < 0.5 * len(values)


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 300)] + [(7, 7), (1000, 999)]
    df = spark.createDataFrame(edges * 2, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 400)} | {1000: 999, 999: 999}
    assert components(df.limit(0)).collect() == []


def test_odd_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    data = [(None, None), (7, ""), (3, " \n "), (5, "One two"), (5, "one TWO"), (None, "one two"), (9, long), (8, long)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 3), (-1, 5), (3, 3), (5, 5), (5, 5), (7, 3), (8, 8), (9, 8)]
    for r in rows:
        if r.doc_id == 9:
            assert np.array(r.fp).astype(np.int64).view(np.uint64) == plain_print(long)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
