"""The pipeline and each of its stages against plain Python, and stages on empty and odd tables."""

import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from refloom.llm import simhash
from refloom.llm.quality_rules import STOP_WORDS
from tests.llm.test_pii import brute as spans_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    chars = sum(map(len, w))
    if len(w) < 50 or 100 * len(covered) > 50 * len(w) or len(w) > 100_000 or not 2.5 <= chars / len(w) <= 12:
        return False
    stops = sum(x.lower().rstrip(".,;:") in STOP_WORDS for x in w)
    bullets = sum(bool(re.match(r"[\x20\x09]*(?:[-*•‣◦]|[0-9]+[.)])\x20", x)) for x in lines)
    ellipses = sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines)
    return (
        len(re.findall(r"[#*$%&|<>]", text)) <= 0.05 * chars
        and stops >= 0.06 * len(w)
        and len(lines) - len(set(lines)) <= 0.5 * len(lines)
        and bullets <= 0.9 * len(lines)
        and ellipses <= 0.3 * len(lines)
    )


def groups(texts):
    """Component of each place, by comparing all fingerprints."""
    prints = [simhash.fingerprint_of(t) for t in texts]
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


def masked(text):
    out, at = [], 0
    for start, kind, end in spans_of(text):
        if start >= at:
            out += [text[at:start], ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_and_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(C.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    passed = stage["quality_rules"](spark, docs, sf)
    assert passed.columns == docs.columns
    want = sorted(i for i, r in rows.items() if kept(r.text))
    assert sorted(r.doc_id for r in passed.collect()) == want and len(want) > 100

    single = stage["simhash"](spark, passed, sf)
    root = groups([rows[i].text for i in want])
    want = [i for k, i in enumerate(want) if root[k] == k]
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == want

    clean = stage["pii"](spark, single, sf)
    assert clean.columns == docs.columns and clean.schema == docs.schema
    clean = {r.doc_id: r for r in clean.collect()}
    assert sorted(clean) == want
    for i in want:
        assert clean[i].text == masked(rows[i].text) and clean[i].n_chars == len(clean[i].text)

    table = spark.createDataFrame(list(clean.values()), docs.schema)
    mix = stage["mixing"](spark, table, sf)
    assert mix.columns == docs.columns
    mix = mix.collect()
    copies = Counter(r.doc_id for r in mix)
    assert set(copies) <= set(want) and max(copies.values()) <= 3 and all(clean[r.doc_id] == r for r in mix)
    sizes = {i: len(words(clean[i].text)) for i in want}
    by_source = Counter()
    taken = Counter()
    for i in want:
        by_source[clean[i].source] += sizes[i]
        taken[clean[i].source] += sizes[i] * copies[i]
    target = targets(by_source)
    for s in by_source:
        smallest = min(sizes[i] for i in want if clean[i].source == s)
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], smallest)

    library = sentencepiece.SentencePieceProcessor(model_file=C.PIECES)
    done = C.run(spark, sf).collect()
    assert sorted(r.doc_id for r in done) == sorted(copies.elements())
    for r in done:
        ids = library.encode(clean[r.doc_id].text, add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)


def targets(sizes):
    """Shares by weight; what is above three times a source's size goes to the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in order}
        full |= above


LONG = "The house of the king is not far from the river and it was built by " * 3


@pytest.mark.parametrize("rows", [0, 1])
def test_stages_take_nulls_and_empty_tables(spark, sf, rows):
    data = [
        (None, None, None, None, None), (1, "", "en", "a", 0), (2, LONG + "one two three", "en", None, 1), (2, LONG + "one two three", "en", None, 1),
        (None, LONG + "four five six", None, "b", None), (3, " ".join(f"the w{i}" for i in range(400)), "en", "a", 9), (4, "x" * 100_000, "en", "a", 9),
    ] if rows else []
    docs = spark.createDataFrame(data, COLUMNS).withColumn("row", F.lit(1)).withColumn("_n", F.lit("x")).withColumn("fp", F.lit(2.0))
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        if name != "sentencepiece":
            assert out.columns == docs.columns, name
        n = len(out.collect())
        assert (n > 0) == bool(rows), name
