"""Cases that a limit on numbers, depth or length would lose."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from refloom.functions import urls as U
from refloom.functions import wikitext as W
from refloom.operators import citations as C
from refloom.operators import context as X
from refloom.operators import quality as Q
from refloom.streaming import parts as ST
from refloom.tables.params import FIELD_ALIASES, KNOWN_PARAMS


@pytest.fixture(scope="module")
def kinds(spark):
    def run(*maps):
        rows = [(i, "book", {"title": "t"} | m) for i, m in enumerate(maps)]
        df = spark.createDataFrame(rows, "i int, cls string, params map<string,string>")
        return [set(r.errors) for r in Q.with_errors(df).orderBy("i").collect()]

    return run


def test_names_of_every_number_and_list(kinds):
    got = kinds(
        {"last1": "A", "last2": "B", "authorlink2": "http://x.org/a"},
        {"last1": "A", "last2": "B", "first3": "C"},
        {"last1": "A", "last2": "B", "last3": "C et al."},
        {"editor1": "A", "editor2": "B", "editor4": "D"},
        {"translator-first2": "X", "translator1": "Y"},
        {"last": "A", "first": "B", "last2": "C"},
        {"last1": "A", "last4": "D", "first9": "E"},
    )
    found = [g & {"bad_paramlink", "first_missing_last", "maint_etal", "missing_name"} for g in got]
    assert found == [
        {"bad_paramlink"}, {"first_missing_last"}, {"maint_etal"}, {"missing_name"}, {"first_missing_last"}, set(), set(),
    ]


def test_repeated_parameters_of_every_field(kinds):
    got = kinds({"place": "a", "location": "b"}, {"type": "a", "medium": "b"}, {"isbn": "1", "ISBN": "2"}, {"page": "1", "pages": "2"})
    assert ["redundant_parameters" in g for g in got] == [True, True, True, False]


def test_names_with_blanks_and_unaccepted_aliases(kinds):
    assert "template doc demo" in FIELD_ALIASES["NoTracking"] and "template doc demo" in KNOWN_PARAMS
    assert "distributor" in FIELD_ALIASES["PublisherName"] and "distributor" not in KNOWN_PARAMS
    assert ["parameter_ignored" in g for g in kinds({"distributor": "x"}, {"template doc demo": "x"})] == [True, False]


def test_plain_text_of_many_parameters_and_deep_nesting(one):
    many = "a {{t|" + "|".join(f"v{i}" for i in range(60)) + "}} b"
    deep = "x " + "{{n|" * 50 + "y" + "}}" * 50 + " z"
    links = "[[a|" * 45 + "b" + "]]" * 45
    assert one(W.strip_code("t", keep_template_params=True), [many, deep]) == [
        "a " + " ".join(f"v{i}" for i in range(60)) + " b", "x y z",
    ]
    assert one(W.strip_code("t"), [many, deep, links, "open {{x and [[y", None]) == ["a  b", "x  z", "b", "open {{x and [[y", None]


def test_domains_under_other_countries(one):
    pages = ["https://www.thestar.com.my/news", "http://bangkokpost.co.th", "nation.com.pk", "https://com.my", "http://a.b.example.de/x", "t.co"]
    assert one(U.top_domain("t"), pages) == ["thestar", "bangkokpost", "nation", "com", "example", "t"]
    listed = U.top_domain("t", ["com.my", "city.kawasaki.jp", "b.example.de"])
    assert one(listed, [*pages[:2], pages[4], "http://x.city.kawasaki.jp"]) == ["thestar", "co", "a", "x"]


def test_stream_counts_every_row_and_goes_on(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def add(name, *days):
        rows = [(day + datetime.timedelta(days=d), "x") for d in days]
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.parquet(f"{source}/{name}")

    def counts():
        run = ST.stream_label_counts(spark, f"{source}/*", "ts timestamp, kind string", target, mark, "ts", "kind")
        run.awaitTermination()
        return {(r.start - day).days: r.n for r in spark.read.parquet(target).collect()}

    add("a", 0, 0, 30)
    assert counts() == {0: 2, 30: 1}
    add("b", 1, 0, 31)
    assert counts() == {0: 3, 1: 1, 30: 1, 31: 1}


def test_long_names_keep_their_length(one):
    from refloom.functions import citation as C

    name = "cite " + "x" * 3000
    assert one(F.length(C.citation_type("t")), ["{{" + name + "|a=b}}"]) == [len(name)]


def test_edits_by_place(spark):
    from refloom.operators import rewriting as R

    t, new = "{{cite web|url=a|date=1}}", "{{cite web|url=a|date=2}}"
    page = f"a {t} <!-- {t} --> <nowiki>{t}</nowiki> {{{{x|{t}}}}} é {t}."
    pages = spark.createDataFrame([(page,), ("none",), ("",), (None,)], "content string")
    got = [r.content for r in R.rewrite_page_templates(pages, "Cite web", "date", "2").collect()]
    assert got == [f"a {new} <!-- {t} --> <nowiki>{t}</nowiki> {{{{x|{t}}}}} é {new}.", "none", "", None]


def _page(n):
    """n templates, each text twice, and a heading before every third."""
    return "".join(
        (f"== H{i} ==\n" if i % 3 == 0 else "") + f"Some words {{{{cite web|title=T{i % (n // 2)}}}}} more.\n" for i in range(n)
    )


def test_sections_and_places_on_a_long_page(spark):
    n = 4000
    df = spark.createDataFrame([(1, _page(n))], "page_id int, content string")
    got = sorted(C.extract_citations(df).collect(), key=lambda r: r.pos)
    assert [r.section for r in got] == [f"H{i - i % 3}" for i in range(n)]
    half = n // 2
    assert all(r.sections_all == [f"H{j - j % 3}" for j in (i % half, i % half + half)] for i, r in enumerate(got))
    rows = [r.citations_features for r in X.context_features(df).collect()]
    assert [r.citation for r in rows] == [r.citations for r in got]
    assert [r.ref_index for r in rows] == [5 * (i % half) + 2 for i in range(n)]


@pytest.mark.parametrize("work", [C.extract_citations, X.context_features], ids=["citations", "context"])
def test_cost_of_a_page_is_not_quadratic(work, spark):
    def seconds(n):
        df = spark.createDataFrame([(1, _page(n))], "page_id int, content string")
        start = time.perf_counter()
        work(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(16_000) < 8 * seconds(4000)  # quadratic: 16 times
