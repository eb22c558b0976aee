"""Toxicity on labels it has not seen, folding, matching, exceptions."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from refloom.llm import queries, toxicity


def test_folding():
    assert toxicity.folded("You 1D10T, ｓｔｕｐіd m0r​оn tr@$h!") == ["you", "idiot", "stupid", "moron", "trash"]
    assert toxicity.folded(None) == toxicity.folded("") == []


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({" bad ": 3.0, " worse ": 4.0, " stem": 2.0, " stemmed ": 5.0, " a": 1.0}, {"not bad", "worse luck"})
    for _ in range(300):
        words = [rng.choice("bad worse stem stemmed stemming a ab not luck ok badly".split()) for _ in range(rng.randrange(12))]
        want = []
        for i, w in enumerate(words):
            fit = [e for e in lexicon.weights if f" {w} ".startswith(e)]
            if fit and not lexicon.exceptions & set(toxicity.phrases(words, i)):
                want.append((i, max(fit, key=lexicon.weights.get)))
        assert lexicon.matches(words) == want


def test_held_out_fold(spark):
    ids = list(range(200)) + [10**12]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for r in df.select("doc_id", toxicity.held_out().alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op8_toxicity(spark, sf)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = rows.join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r for r in rows if r.toxic == t] for t in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.005 * len(clean)


def test_learned_exceptions(spark):
    rng = random.Random(1)
    filler = [f"{a}{b}ish" for a in "klmnprst" for b in ("o", "a", "u", "ei")]

    def text(*inner):
        w = [rng.choice(filler) for _ in range(30)]
        for x in inner:
            w.insert(rng.randrange(len(w)), x)
        return " ".join(w)

    data = [(text("zounds", "zounds", "gadzook"), 1) for _ in range(60)] + [(text(), 0) for _ in range(200)]
    data += [(text("gadzook museum"), 0) for _ in range(8)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert " zounds " in lexicon.weights and "gadzook museum" in lexicon.exceptions
    assert lexicon.score(text("z0unds", "ZOUNDS")) > 0.9 > 0.1 > lexicon.score(text("gadzook museum"))


@pytest.mark.parametrize("case", ["rows", "no rows", "no labels"])
def test_odd_tables(spark, case):
    data = [(None, None), (1, ""), (2, "x " * 100_000), (3, "a b"), (3, "a b")]
    docs = spark.createDataFrame(data if case != "no rows" else [], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(3, 1), (2, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, labels.limit(0) if case == "no labels" else labels).collect()
    assert len(rows) == (0 if case == "no rows" else len(data))
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
