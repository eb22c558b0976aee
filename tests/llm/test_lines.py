"""Line deduplication against plain counting; the perfect hash on its own."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np

from refloom.llm import line_dedup, queries

SCHEMA = "doc_id long, text string, lines int, gone string, h long"


def key(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return low.strip(" \t\n\x0b\x0c\r")


def plain(rows):
    held = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(doc_id)
    most = {
        k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(k) >= 20 and len(ids) >= 3
    }
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in most or most[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def asked(spark, rows, tmp_path):
    full = [(*r, i, "x", i) for i, r in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op13_line_dedup(spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "bigint", "string"]
    return sorted((tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in df.collect()), key=repr)


def test_random_lines(spark, tmp_path):
    rng = random.Random(4)
    pool = [f"line number {i} of the pool {'x' * (i % 9)}"[: 17 + i % 12] for i in range(150)]
    rows = [
        (i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(pool)) for _ in range(rng.randrange(12))))
        for i in rng.sample(range(10**9), 400)
    ]
    assert asked(spark, rows, tmp_path) == plain(rows)


def test_nulls_ties_repeats_long_texts(spark, tmp_path):
    line, other = "this line stands in many documents", "Ünicode line of twenty-one ÄÖ code points"
    rows = [
        (None, None), (None, line), (1, ""), (2, "\n\n"), (3, f"{line}\n{line}\nown"), (4, f"\x0b{line.upper()}\r\nrest"),
        (4, f"{line}\x0c\nrest"), (5, "same rows of one text here\nend"), (5, "same rows of one text here\nend"),
        (5, "same rows of one text here\nend"), (6, other), (7, other.lower()), (8, other), (9, other), (None, "only nameless rows hold it"),
        (None, "only nameless rows hold it"), (None, "only nameless rows hold it\n\n"), (-1, "a" * 19), (-2, "a" * 19), (-3, "a" * 19),
        (10, "\n".join(f"a line of a long text, number {i % 5000}" for i in range(30_000))),
        (11, "\n".join(f"a line of a long text, number {i}" for i in range(3000))),
        (12, "\n".join(f"a line of a long text, number {i}" for i in range(0, 6000, 2))),
        (13, line),
    ]
    assert asked(spark, rows, tmp_path) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path) == []


def test_a_crowded_line_is_probed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE_LINES", 64)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    rows = [(i, f"a line that every document holds\nthe own line of document {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.without_repeats(docs).collect()
    assert Counter(r.n_dropped for r in got) == {1: 899, 0: 1} and max(got, key=lambda r: r.doc_id).n_dropped == 0
    assert all(r.kept == f"the own line of document {r.doc_id}" for r in got if r.n_dropped)


def test_perfect_hash_is_minimal_and_complete():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 20_000):
        h, f = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**31), 2**31 - 1, n).astype(np.int32)
        h[n // 2 :] = h[: n - n // 2]  # equal hashes, apart by fingerprint only
        found = line_dedup.PerfectHash.of(h, f)
        assert sorted(line_dedup.PerfectHash(found.sizes, found.bits).numbers(h, f)) == list(range(n))
        assert 8 * len(found.bits) < 4.5 * n + 64
