"""The mix against a plain solution of the same problem, and its limits."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from refloom.llm import mixing, queries
from tests.llm.test_pipeline import targets, words


def rate_of(sizes, target):
    """Rates of one source by bisection."""
    total = sum(sizes)
    if target >= 3 * total * (1 - 1e-12):
        return [3.0] * len(sizes)
    scale = sum(n * n for n in sizes) / total

    def rates(x):
        return [min(3.0, math.exp(min(x * n / scale, 2.0))) for n in sizes]

    lo, hi = -1e6, 1e6
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * r for n, r in zip(sizes, rates(mid), strict=True)) < target else (lo, mid)
    return rates(lo)


def test_dual_is_the_plain_solution(spark):
    data = [("0a", n, k) for n, k in ((1, 5), (3, 2), (10, 1), (400, 2), (5000, 1))]
    data += [("0b", n, 1) for n in range(1, 200)] + [("0c", 7, 30)] + [("0d", 1, 1), ("0d", 100_000, 1)]
    cells = spark.createDataFrame(data, "_skey string, _n long, _k long")
    sources = cells.groupBy("_skey").agg(F.sum(F.col("_n") * F.col("_k")).alias("source_size"))
    for factor in (0.02, 1.7, 2.9):
        solved = mixing.solve(cells, sources.withColumn("target", F.col("source_size") * factor)).collect()
        for r in solved:
            sizes = [n for s, n, k in data for _ in range(k) if s == r._skey]
            want = rate_of(sizes, r.target)
            got = [min(3.0, math.exp(min(r._x * n / r._c, 2.0))) for n in sizes]
            assert sum(n * x for n, x in zip(sizes, got, strict=True)) == pytest.approx(r.target, rel=1e-5)
            assert got == pytest.approx(want, rel=1e-4, abs=1e-6)


def check(rows, near=0.01):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for source, r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sizes[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert all(r.source_size == sizes[s] for x, r in rows if x == s)
        assert abs(taken[s] - want[s]) <= max(near * want[s], 3)


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_mixing(spark, sf).collect()
    assert len(rows) == len(docs) and all(r.size == len(words(docs[r.doc_id].text)) for r in rows)
    check([(docs[r.doc_id].source, r) for r in rows])
    again = queries.op7_mixing(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_full_sources_and_odd_rows(spark):
    data = [(i, "w " * (1 + i % 40), "big") for i in range(3000)] + [(10_000 + i, "one two", "tiny") for i in range(9)]
    data += [(20_000 + i, "a b c", None) for i in range(40)] + [(None, None, "void"), (30_000, "", "void"), (None, "x y", "")] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("_n", F.lit("x")).withColumn("size", F.lit(1))
    rows = mixing.mix(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))).collect()
    assert len(rows) == len(data)
    by_id = defaultdict(list)
    for i, text, source in data:
        by_id[(-1 if i is None else i, len(words(text)))].append(source)
    check([(by_id[(r.doc_id, r.size)][0], r) for r in rows])
    assert {r.copies for r in rows if 10_000 <= r.doc_id < 10_009} == {3}
    assert len(mixing.mix(docs).collect()) == len(data)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_copies_of_one_text_are_dealt_by_hash(spark):
    data = [(i, "same words here", "s") for i in range(2000)] + [(5000 + i, "other " * 9, "t") for i in range(2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    check([("s" if r.doc_id < 5000 else "t", r) for r in rows], near=0.001)


def test_equal_rows_meet_the_target_together(spark):
    data = [(1, "ten words " * 5, "s")] * 1000 + [(i, "w " * (1 + i % 9), "t") for i in range(500)] + [(None, None, "s")] * 3
    data += [(7, "same text in null source", None)] * 301
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    rows = mixing.mix(docs).collect()
    source = lambda r: None if r.size == 5 and r.doc_id == 7 else "s" if r.size in (0, 10) and r.doc_id in (1, None) else "t"
    check([(source(r), r) for r in rows], near=0.01)
    copies = [r.copies for r in rows if source(r) == "s" and r.size]
    assert len(copies) == 1000 and max(copies) - min(copies) == 1
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns
    assert kept.where("source = 's'").count() == sum(copies)
