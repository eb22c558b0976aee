import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from refloom.operators import context as X
from refloom.operators import features as M
from refloom.operators import labels as L
from refloom.streaming import parts as ST


def test_rule_label(spark):
    rows = [
        ("cite web", {"PMID": "1"}, "journal"), ("cite web", {"PMC": "1", "ISBN": "2"}, "journal"),
        ("cite web", {"DOI": "1"}, "journal"), ("cite web", {"ISBN": "1"}, "book"),
        ("cite journal", {"ISBN": "1", "DOI": "2"}, "journal"), ("cite book", {"ISBN": "1", "DOI": "2", "PMID": "3"}, "book"),
        ("cite web", {"ISBN": "1", "DOI": "2"}, "other"), ("cite web", {"OCLC": "1"}, "other"), ("cite web", {}, "other"),
    ]
    df = spark.createDataFrame(rows, "type_of_citation string, ID_list map<string,string>, expected string")
    assert L.label_book_journal(df).where("actual_label <> expected").count() == 0
    wide = L.id_columns(df).where("PMID = '3'").first()
    assert (wide.DOI, wide.ISBN, wide.ZBL) == ("2", "1", None)
    assert L.with_ids(df.unionAll(df)).count() == 8


def test_news(spark):
    df = spark.createDataFrame([(1, "https://www.abc.com/x", "other"), (2, "https://abc.com", "book"), (3, "", "other"), (4, "http://q.org", "other")],
                               "page_id int, URL string, actual_label string")
    domains = spark.createDataFrame([("abc",), ("abc",)], "domain string")
    got = {r.page_id: (r.actual_label, r.tld) for r in L.label_news(df, domains).collect()}
    assert got == {1: ("news", "abc"), 2: ("book", "abc"), 3: ("other", ""), 4: ("other", "q")}


def test_context(spark):
    words = " ".join(f"w{i}," for i in range(60))
    page = f"{words} {{{{c|1}}}} mid [[Link]] == H == {{{{c|2}}}} {{{{c|1}}}}"
    pages = spark.createDataFrame([(1, page)], "page_id int, content string")
    rows = X.explode_features(X.context_features(pages)).collect()
    assert [(r.retrieved_citation, r.ref_index) for r in rows] == [("{{c|1}}", 60), ("{{c|2}}", 62), ("{{c|1}}", 60)]
    assert rows[0].neighboring_words == [f"w{i}" for i in range(20, 60)]
    assert rows[1].neighboring_words[-2:] == ["{{c|1}}", "mid"] and rows[1].neighboring_tags[-2:] == ["WIKICODE", "WORD"]
    assert {r.total_words for r in rows} == {64}


def test_unknown_words(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "a", "a"]), (3, [])], "k int, neighboring_words array<string>")
    got = {r.k: r.neighboring_words for r in X.unk_rare_words(df, "k").collect()}
    assert got == {1: ["a", "<UNK>", "a"], 2: ["a", "a", "a"], 3: ["<UNK>"]}


@pytest.mark.parametrize("slots", [16, 256, X.SLOTS])
def test_unknown_words_with_crowded_slots(spark, slots, monkeypatch):
    monkeypatch.setattr(X, "SLOTS", slots)
    rnd = random.Random(7)
    rows = [(i, [f"w{int(rnd.paretovariate(0.7)) % 900}" for _ in range(rnd.randrange(30))], "x") for i in range(200)]
    rows += [(200, None, "x"), (201, ["é", "é"], "x")]
    seen = Counter(w for _, ws, _ in rows for w in ws or [])
    df = spark.createDataFrame(rows, "k int, neighboring_words array<string>, word string")
    got = {r.k: r.neighboring_words for r in X.unk_rare_words(df, "k").collect()}
    assert got == {k: [w if seen[w] > 4 else "<UNK>" for w in ws or []] or ["<UNK>"] for k, ws, _ in rows}


def test_join_with_hot_text(spark):
    features = spark.range(1000).select(F.lit("{{hot}}").alias("retrieved_citation"), F.col("id").alias("page_id"))
    labelled = spark.createDataFrame([("{{hot}}", "book"), ("{{cold}}", "news")], "citations string, label string")
    joined = X.join_selected(features, labelled)
    assert joined.count() == 1000 and joined.select("page_id").distinct().count() == 1000


def test_bias_and_sequences(spark):
    df = spark.createDataFrame([(1, "{{cite web|doi=10.1|url = http://x|title=t}}")], "id long, citations string")
    assert M.clear_bias(df, "id").first().citations == "{{cite web|doi = |url = |title=t}}"
    assert M.clear_bias(df, "id", 1.0).first().citations == "{{cite web|||title=t}}"
    index = M.char_index(M.char_counts(df))
    ids = M.char_sequence(df, index, length=8).first().char_ids
    table = {r.char: r.idx for r in index.collect()}
    assert ids == [table[c] for c in "title=t}}"[-8:]]
    short = spark.createDataFrame([(1, "t")], "id long, citations string")
    assert M.char_sequence(short, index, length=3).first().char_ids == [0, 0, table["t"]]


def test_sections_encoded(spark):
    df = spark.createDataFrame([(1, ["A", "Z"]), (2, ["B"])], "id int, sections array<string>")
    rows = {r.id: (r.A, r.B, r.others) for r in X.encode_sections(df, ["A", "B"]).collect()}
    assert rows == {1: (1, 0, 1), 2: (0, 1, 0)}
    top = X.top_sections(df.unionAll(df.where("id = 2")), k=2).collect()
    assert [(r.section_name, r["count"]) for r in top] == [("B", 2), ("A", 1)]


def test_suffix_table(spark):
    hosts = {
        "https://a.bbc.co.uk/x": "bbc", "http://x.y.z.k12.ma.us": "z", "http://ma.us": "", "b.tokyo.jp": "tokyo", "c.kawa.jp": "", "d.c.kawa.jp": "d",
        "city.kawa.jp": "city", "x.city.kawa.jp": "city", "plain.com": "plain", "localhost": "localhost", "": "", None: "", "1.2.3.4": "1.2.3.4",
        "K12.MA.US": "", "q.K12.MA.US.": "q",
    }
    rules = ["// x", " co.uk ", "k12.ma.us", "ma.us", "*.kawa.jp", "!city.kawa.jp", "com", "", "us // note"]
    suffixes = spark.createDataFrame([(r,) for r in rules], "s string")
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "page_id int, URL string")
    got = {r.URL: r.tld for r in L.with_domain(df, suffixes=suffixes).collect()}
    assert got == hosts
    empty = L.with_domain(df, suffixes=suffixes.where("false")).where("URL = 'https://a.bbc.co.uk/x'").first()
    assert empty.tld == "co"


def test_exact_split_with_ties_and_rare_labels(spark):
    rows = [("big", i) for i in range(997)] + [("rare", 1), ("rare", 2), ("one", 5), (None, None), (None, None)]
    rows += [("same", 7)] * 501
    df = spark.createDataFrame(rows, "lab string, k long").repartition(5)
    got = M.stratified_split(df, "k", label="lab")
    counts = {(r.lab, r.split): r["count"] for r in got.groupBy("lab", "split").count().collect()}
    assert counts == {
        ("big", "train"): 897, ("big", "test"): 100, ("rare", "train"): 1, ("rare", "test"): 1, ("one", "train"): 1,
        (None, "train"): 1, (None, "test"): 1, ("same", "train"): 451, ("same", "test"): 50,
    }
    assert got.columns == ["lab", "k", "split"]
    assert M.stratified_split(df.where("false"), "k", label="lab").count() == 0


def test_stream_reads_the_domains_of_each_batch(spark, tmp_path):
    pages, domains = str(tmp_path / "pages"), str(tmp_path / "domains")
    frame = lambda i, host: spark.createDataFrame([(i, f"{{{{cite web|title=T|url=http://{host}.com}}}}")], "page_id int, content string")
    run = lambda: ST.stream_dump_parts(
        spark, pages, "page_id int, content string", str(tmp_path / "out"), str(tmp_path / "mark"), domains=domains
    ).awaitTermination()
    frame(1, "abc").write.parquet(pages)
    spark.createDataFrame([("xyz",)], "domain string").write.parquet(domains)
    run()
    frame(2, "abc").write.mode("append").parquet(pages)
    spark.createDataFrame([("abc",)], "domain string").write.mode("append").parquet(domains)
    run()
    got = {r.page_id: r.actual_label for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "other", 2: "news"}
