"""Quality rules against plain Python and SQL, and the co-trained classifier on labels it has not seen."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from refloom.llm import cotraining, quality_rules, queries
from tests.llm.test_pipeline import kept


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def odd_texts():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "x y z x y z", "one\ntwo\none\n\n \none", "#*$%&|<> é日 👍\xa0b", "\x0b\x0ca\rb"]
    texts += [" ".join(rng.choice("the of a b c d.".split()) for _ in range(rng.randrange(90))) for _ in range(120)]
    return texts + ["the " * 5000, "\n".join(["- the of it"] * 40 + ["and so on..."] * 40)]


def test_measures_and_verdicts(spark):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("x"))
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(text), repr((text or "")[:60])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == kept(text)
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_rules_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.op3_quality_rules(spark, sf)
    want = con.sql(queries.QUALITY_SQL)
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_rules_agree_with_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op3_quality_rules(spark, sf).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def test_classifier_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_quality_cotraining(spark, sf)
    assert rows.columns == ["doc_id", "held_out", "score", "content_score", "page_score", "kept"]
    rows = rows.join(labels, "doc_id").where("held_out").collect()
    bad = [r for r in rows if not r.quality]
    assert len(bad) > 10 and sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


@pytest.mark.parametrize("case", ["rows", "no rows", "no labels"])
def test_classifier_on_odd_tables(spark, case):
    data = [(None, None, None, None)] + [(i, f"the house {i} of the king " * (1 + i % 9), "en", None) for i in range(40)] * 2
    docs = spark.createDataFrame(data if case != "no rows" else [], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = cotraining.scored(docs.withColumn("score", F.lit(1)), labels.limit(0) if case == "no labels" else labels, rounds=1).collect()
    assert len(rows) == (0 if case == "no rows" else len(data)) and all(0 <= r.score <= 1 for r in rows)
    if case == "no labels":
        assert all(r.score == 0.5 and r.kept for r in rows)
