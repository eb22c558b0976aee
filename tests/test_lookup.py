import random

from pyspark.sql import functions as F

from refloom.functions import similarity as S
from refloom.operators import lookup as K


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratio_against_plain_table(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcd é") for _ in range(n))
    pairs = [("kitten", "sitting"), ("", ""), ("", "x"), ("same", "same")]
    pairs += [(word(rnd.randint(0, 130)), word(rnd.randint(0, 130))) for _ in range(60)]
    pairs += [(word(n), word(m)) for n in (59, 60, 61, 119, 120, 121) for m in (60, 61, 121, 300)]
    pairs += [("\U0001d4b3 ye", "ye \U0001d4b3"), ("%.*[]\\", "\\[]*"), ("a" * 180, "a" * 180 + "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", S.similarity_ratio("a", "b").alias("r"), S.ratio_bound("a", "b").alias("lev"),
                     S.length_bound("a", "b").alias("len")).collect()
    for r in rows:
        total = len(r.a) + len(r.b)
        expected = 1.0 if total == 0 else 2 * lcs(r.a, r.b) / total
        assert abs(r.r - expected) < 1e-12
        assert r.lev >= expected - 1e-12 and r.len >= expected - 1e-12


def test_scan_stops_at_first_miss(spark):
    books = (
        '{"items":[{"volumeInfo":{"title":"Deep sea fisx"}},{"kind":"x"},{"volumeInfo":{"title":"Deep sea fish",'
        '"industryIdentifiers":[{"type":"ISBN_10","identifier":"1"}]}},{"volumeInfo":{"title":"zzz"}},'
        '{"volumeInfo":{"title":"Deep sea fish"}}]}'
    )
    df = spark.createDataFrame([("Deep sea fish", books), ("Other", books)], "t string, j string")
    rows = K.best_candidate(df.withColumn("c", K.parse_books("j")), "t", "c").collect()
    assert rows[0].best.title == "Deep sea fish" and rows[0].best.ids[0].type == "isbn_10" and rows[0].n_scanned == 2
    assert rows[1].best is None


def test_scan_computes_only_what_may_reach(spark):
    title = "A history of northern rivers"
    lists = [
        ["x" * 80, title], [title[::-1], title], [title, title + "!", "zzz", title], [], None, [None, title],
        [title[1:] + "a", title, title],
    ]
    df = spark.createDataFrame([(i, title, None if c is None else [(t, [("k", "v")]) for t in c]) for i, c in enumerate(lists)],
                               "i int, t string, c array<struct<title:string,ids:array<struct<type:string,value:string>>>>")
    got = K.best_candidate(df, "t", "c", compared="n_exact").orderBy("i")
    assert [(r.n_scanned, r.n_exact) for r in got.collect()] == [(0, 0), (0, 0), (2, 2), (0, 0), (0, 0), (0, 0), (3, 3)]
    assert [r.best.title if r.best else None for r in got.collect()] == [None, None, title, None, None, None, title]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_disambiguate_prefers_publications(spark):
    cites = spark.createDataFrame(
        [(1, "cite book", "A long title", "other"), (2, "cite book", "B long title", "other"),
         (3, "cite web", "A long title", "other"), (4, "cite book", "A long title", "book")],
        "page_id int, type_of_citation string, Title string, actual_label string")
    works = spark.createDataFrame(
        [("A long title", '{"message":{"items":[{"DOI":"10.1/a","title":["A long title"]}]}}')], "t string, r string")
    books = spark.createDataFrame(
        [("B long title", '{"items":[{"volumeInfo":{"title":"B long titl","industryIdentifiers":[{"type":"ISBN_13","identifier":"9"}]}}]}')],
        "t string, r string")
    got = {r.page_id: [(i.type, i.value) for i in r.acquired_ID_list] for r in K.disambiguate(cites, works, books).collect()}
    assert got == {1: [("DOI", "10.1/a")], 2: [("isbn_13", "9")], 3: [], 4: []}


def test_requests(spark):
    df = spark.createDataFrame([(i, f"t{i}", None if i % 2 else "a b") for i in range(200)], "k int, t string, a string")
    batches = K.request_batches(df, "k").groupBy("batch").agg(F.count("*").alias("n"), F.min("k").alias("k")).orderBy("batch").collect()
    assert [(r.n, r.k) for r in batches] == [(75, 0), (75, 75), (50, 150)]
    params = K.request_params(df, "k", "t", "a")
    assert params.count() == 100
    urls = K.request_urls("t", "a", F.lit("P&Q"))
    row = df.where("k = 0").select(urls["books"].alias("b"), urls["works"].alias("w")).first()
    assert row.b.endswith("q=t0+inauthor:a+b+intitle:t0+inpublisher:P%26Q") and row.w.endswith("?rows=1&query.author=a+b&query.title=t0")


def test_top_results(spark):
    df = spark.createDataFrame([('{"message":{"items":[]}}',), ('{"message":{"items":[{"title":["a"]},{"title":["b"]}]}}',)], "j string")
    rows = K.top_k_results(df.withColumn("c", K.parse_works("j")), "c", 1).collect()
    assert rows[0].message and rows[0].c is None
    assert rows[1].message is None and len(rows[1].c) == 1
