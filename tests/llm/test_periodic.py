"""Periodic runs against a search over all starts and periods."""

import random
import re
import time
import zlib
from fractions import Fraction
from hashlib import sha256

from refloom.llm import periodic, queries


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            shorter = any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not shorter:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_random_words_of_few_kinds():
    rng = random.Random(1)
    for k in range(3000):
        words = [rng.randrange(1 + k % 4) for _ in range(rng.randrange(60))]
        assert periodic.runs_of(words) == plain_runs(words), words


def test_composed_repeats():
    rng = random.Random(2)

    def part(depth):
        if depth == 0:
            return [rng.randrange(5) for _ in range(rng.randrange(1, 5))]
        inner = [x for _ in range(rng.randrange(1, 3)) for x in part(depth - 1)]
        return inner * rng.choice([1, 1, 2, 4, 5, 7]) + part(0)[: rng.randrange(3)]

    for _ in range(400):
        words = part(rng.randrange(1, 4))[:400]
        assert periodic.runs_of(words) == plain_runs(words), words


def test_fibonacci_words_and_prefix_repeats():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.runs_of(b) == plain_runs(b)
    words = ([1] * 9 + [2]) * 6 + [1] * 4
    assert periodic.runs_of(words) == plain_runs(words)


def test_very_long_texts_are_not_quadratic():
    start = time.perf_counter()
    assert periodic.runs_of([0] * 1_000_000) == [(0, 1_000_000, 1)]
    block = list(range(1000)) + [0] * 1000
    found = periodic.runs_of(block * 200)
    assert (0, 400_000, 2000) in found and len(found) == 201
    assert time.perf_counter() - start < 60


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept))


SCHEMA = "doc_id long, text string, runs int, collapsed string, best string"
NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def asked(spark, rows, tmp_path):
    full = [(*r, i, "x", None) for i, r in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op12_periodic_runs(spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["bigint"] * 6 + ["string"] * 2
    return [tuple(r[c] for c in NAMES) for r in df.collect()]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab c") * rng.randrange(1, 3) for _ in range(rng.randrange(120)))) for i in range(300)]
    rows += [
        (None, None), (None, "a " * 9), (7, ""), (7, " \t\n"), (7, "a\x0ba\x0ca\ra\na a"), (7, "A a " * 4), (-3, "é " * 50),
        (5, "x y " * 30 + "z"), (5, "x y " * 30 + "z"), (2**62, "word"), (8, "a b c d e f " * 800),
    ]
    assert sorted(asked(spark, rows, tmp_path), key=repr) == sorted((row(*r) for r in rows), key=repr)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.op12_periodic_runs(spark, sf).collect()
    some = {r.doc_id: r.text for r in docs if len((r.text or "").split()) < 600}
    assert len(some) > 100
    assert {r.doc_id: tuple(r[c] for c in NAMES) for r in got if r.doc_id in some} == {i: row(i, t) for i, t in some.items()}


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path) == []
