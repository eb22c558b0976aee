"""Personal data: seeds against Python's regular expressions, bootstrapping and masking on small texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from refloom.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    spans = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((m.start(), k, m.end()))
    return sorted(spans)


ODD = [
    None, "", " ", "a@b.c@d.e", "a@b.co_x@d.e", "a@b..c", ".@d.e a@b.c.@d.e", "1.2.3.45.6.7.8", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1112 x 4111111111111111", "+1 (980) 555-6268 and +12 3", "+1+2 345 678 901+", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "é日本 a@b.c 日本 +49 30 1234567 👍 10.0.0.1", "5 5 5 5  5", "x" * 5000 + "@" + "y" * 50, "a@b" + ".c" * 3000, "1" * 4000 + ".2.3.4", "+" + "1 " * 3000,
    "000000000000", "mail:x.y+z%q@a-b.c-d.\n1.1.1.1\t2.2.2.2", "@@@ ... +++ 1-1-1-",
]


def random_texts(n=400):
    rng = random.Random(3)
    bits = ["1", "0", "4111111111111111", "255", "256", ".", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "_", "é", "\n", "+49 ", "1.2.3.4", "x@y.z"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_seeds_are_those_of_the_plain_patterns(spark):
    texts = ODD + random_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert [tuple(s) for s in rows[i].base] == brute(text), repr((text or "")[:60])
        assert set(map(tuple, rows[i].base)) <= set(map(tuple, rows[i].spans))


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_pii(spark, sf).collect():
        spans = brute(texts[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_contexts_discover_and_common_words_do_not(spark):
    seeds = [f"ring hotline: +1 (980) 555-62{i:02d} today" for i in range(8)]
    others = ["write hotline: 980-555-6999 now", "the 980-555-7000 is the code of the house"]
    noise = [f"the +1 (980) 555-72{i:02d} and the the the the" for i in range(8)]
    texts = seeds + others + noise
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    found = [tuple(s) for s in rows[8].spans]
    assert found == [(15, 3, 27)] and rows[8].base == []
    assert rows[9].spans == []


def test_masked(spark):
    texts = ["call +1 (980) 555-6268 or a@b.c.", "4111111111111111", "none", "+4111111111111111 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.join(pii.find(docs), "doc_id").select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("t"))
    out = {r.doc_id: r.t for r in rows.collect()}
    assert out[0] == "call <PHONE> or <EMAIL>." and out[1] == "<CARD>" and out[2] == "none"
    assert "411" not in out[3]


@pytest.mark.parametrize("rows", [0, 1])
def test_nulls_and_clashing_names(spark, rows):
    data = [(None, None, 1), (5, "a@b.c", 2), (5, "a@b.c", 2), (None, "a@b.c", 3)] if rows else []
    docs = spark.createDataFrame(data, "doc_id long, text string, key int").withColumn("_base", F.lit("x")).withColumn("spans", F.lit(1))
    out = pii.find(docs)
    assert out.columns == ["doc_id", "key", "base", "spans"]
    assert sorted(len(r.spans) for r in out.collect()) == [0, 1, 1, 1][: len(data)]


def test_discovered_values_vouch_for_further_patterns(spark):
    texts = [f"ring hotline: +1 (980) 555-62{i:02d} today" for i in range(24)]
    texts += [f"hotline: 980-555-690{i} extension" for i in range(5)] + ["dial 980-555-7777 extension"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [tuple(s) for s in rows[24].spans] == [(9, 3, 21)]
    assert [tuple(s) for s in rows[29].spans] == [(5, 3, 17)] and rows[29].base == []


def test_identifiers_with_blanks_and_patterns_of_several_words(spark):
    texts = [f"ring hotline: +1 (980) 555-62{i:02d} today" for i in range(24)]
    texts += ["write hotline: 980 555 6999 now", "hotline: 980 555 6998 10.0.0.1"]
    texts += [f"my phone number is +1 (980) 555-72{i:02d} this is it and that is all" for i in range(9)]
    texts += ["phone number is 980-555-7000", "it is 2019", "hotline:" + " " * 200 + "980 555 7123"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs).collect()}
    assert rows[24] == [(15, 3, 27)]
    assert rows[25] == [(9, 3, 21), (22, 1, 30)]
    assert rows[35] == [(16, 3, 28)] and rows[36] == []
    assert rows[37] == [(208, 3, 220)]


def test_totals_are_those_of_plain_counting(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(100)
    counts = {}
    for r in docs.collect():
        ws = re.findall(r"[^ \t\n\x0b\x0c\r]+", (r.text or "").lower())
        for k in range(1, 4):
            for i in range(len(ws) - k + 1):
                run = " ".join(ws[i : i + k])
                counts[run] = counts.get(run, 0) + 1
    some = sorted(counts)[::50]
    got = pii._totals(docs, "text", spark.createDataFrame([(w,) for w in some], "word string"))
    got = {r.word: r.total for r in got.collect()}
    assert {w: got[w] for w in some} == {w: counts[w] for w in some}
