import ast

import pytest

from refloom.operators import citations as O
from refloom.operators import quality as Q
from refloom.tables.params import FIELD_ALIASES


SOURCE = ast.parse(open(__file__, encoding="utf-8").read())
_DONE = {}


def _texts(function):
    """All literal citations that a helper is called with in this file: one job serves all tests."""
    calls = [n for n in ast.walk(SOURCE) if isinstance(n, ast.Call) and getattr(n.func, "id", "") == function]
    return [c.args[1].value for c in calls if not c.keywords and isinstance(c.args[1], ast.Constant)]


def normal(spark, text, **options):
    if options:
        df = spark.createDataFrame([(text, "x")], "citation string, title string")
        return O.normalize_citations(df, **options).first()
    if "normal" not in _DONE:
        df = spark.createDataFrame([(t, "x") for t in _texts("normal")], "citation string, title string")
        _DONE["normal"] = {r.citation: r for r in O.normalize_citations(df).collect()}
    return _DONE["normal"][text]


def test_journal_with_numbered_authors(spark):
    r = normal(spark, "{{cite journal|doi=10.1111/j.1|title=The ''Banksia'' (Proteaceae)|issue=6|journal=[[GCB|Global Change]]"
                      "|year=2008|volume=14|last2=Gove|first2=A. D.|last1=Fitz|first1=M. C.|pages=1–16}}")
    assert [(p.last, p["first"]) for p in r.Authors] == [("Fitz", "M. C."), ("Gove", "A. D.")]
    assert (r.Title, r.Periodical, r.Date, r.Pages) == ("The Banksia (Proteaceae)", "Global Change", "2008", "1-16")
    assert (r.Volume, r.Issue, r.ID_list) == ("14", "6", {"DOI": "10.1111/j.1"})
    assert r.page_title == "x"


def test_links_and_scripts(spark):
    r = normal(spark, "{{Citation|publisher=[[World Bank]]|title=Дороги (Roads)|last1=Shah|first1=A.|authorlink1=A Shah"
                      "|isbn=978-0821369418|date=June 27, 1857|location=[[Boston]]}}")
    assert (r.PublisherName, r.Title, r.Date, r.PublicationPlace) == ("World Bank", "Дороги (Roads)", "1857-06-27", "Boston")
    assert r.Authors[0].link == "A Shah"


def test_class_rules(spark):
    e = normal(spark, "{{cite encyclopedia|title=Art|encyclopedia=Enc|url=http://abc.org}}")
    assert (e.Title, e.Chapter, e.Periodical, e.URL) == ("Enc", "Art", "", "http://abc.org")
    strict = normal(spark, "{{cite encyclopedia|title=Art|encyclopedia=Enc}}", strict=True)
    assert (strict.Title, strict.Periodical) == ("Art", "Enc")
    ep = normal(spark, "{{cite episode|title=Pilot|series=Show|season=2|number=3|url=http://abc.org}}")
    assert (ep.Title, ep.Chapter, ep.Series, ep.Issue) == ("Show", "Pilot", "Season 2. Episode 3", "")
    m = normal(spark, "{{cite map|title=Atlas|map=Sheet 3|mapurl=http://abc.org}}")
    assert (m.Title, m.Chapter, m.URL, m.TitleType) == ("Atlas", "Sheet 3", "http://abc.org", " (Map)")
    a = normal(spark, "{{cite arxiv|title=T|eprint=1501.00001|version=v2|publisher=P|url=http://abc.org}}")
    assert (a.Periodical, a.PublisherName, a.URL, a.ID_list) == ("arXiv", "", "", {"ARXIV": "1501.00001v2"})
    t = normal(spark, "{{cite thesis|title=T|degree=PhD|date=n.d.}}")
    assert (t.TitleType, t.Date, t.Chron) == (" (PhD thesis)", "", "n.d.")
    c = normal(spark, "{{cite book|title=T|author=A|contribution=Foreword|contributor=C}}")
    assert [p.last for p in c.Authors] == ["C"]
    j = normal(spark, "{{cite journal|title=none|journal=J|pmc=12}}")
    assert (j.Title, j.URL) == ("", "//www.ncbi.nlm.nih.gov/pmc/articles/PMC12")
    late = normal(spark, "{{cite journal|title=T|pmc=12|embargo=2030-01-01}}", as_of_date="2026-01-01")
    assert late.URL == ""
    ml = normal(spark, "{{cite mailing list|title=T|mailing-list=L}}")
    assert (ml.Periodical, ml.TitleType) == ("L", " (Mailing list)")


def test_failures(spark):
    assert normal(spark, "no braces at all").Title == "Citation generic template not possible"
    assert normal(spark, "{{unknown|title=x}}").Title == ""
    assert normal(spark, "{{cite web|title=x").Title == "x"


def test_minimal_and_compact(spark):
    df = spark.createDataFrame([("{{cite web|title=x|volume=3}}", "p", "cite web")], "citation string, page_title string, type_of_citation string")
    n = O.normalize_citations(df)
    assert O.minimal(n).columns == ["type_of_citation", "page_title", "Title", "URL", "Authors", "ID_list", "citations"]
    assert O.compact_fields(n).first().fields == {"Title": "x"}


def test_every_field_alone_is_as_among_all(spark):
    more = [
        "{{cite conference|title=T|book-title=B|url=http://a.org|format=PDF}}", "{{cite map|map=M|map-url=http://m.org|title=A|url=http://a.org}}",
        "{{cite episode|title=E|series=S|season=2|number=3|title-link=L|url=http://a.org}}", "{{cite episode|title=E|series=S|series-no=4|title-link=L}}",
        "{{cite serial|title=T|episode=E|issue=4}}", "{{cite arxiv|title=T|arxiv=0706.0001|version=v2|doi=10.1/x|chapter=C|url=http://a.org|pages=3}}",
        "{{cite arxiv|title=T|eprint=0706.0001|class=math|author=A|date=2001}}", "{{cite encyclopedia|title=T|encyclopedia=E|url=http://a.org|format=PDF}}",
        "{{citation|title=T|encyclopedia=E|chapter=C|journal=J|script-title=ru:X}}", "{{cite book|contributor=A B|contribution=Foreword|title=T|last=C|first=D}}",
        "{{cite journal|title=none|journal=J|pmc=12|volume=3|issue=4|date=May 2001|access-date=1 May 2002|at=p. 4}}",
        "{{cite mailing list|title=T|mailing-list=L}}", "{{cite interview|title=T|others=O|type=TV|degree=PhD}}", "{{cite thesis|title=T|degree=PhD|place=P}}",
        "no braces", "{{unknown|title=x}}",
    ]
    df = spark.createDataFrame([(t,) for t in [*_texts("normal"), *more]], "citation string")
    whole = {r.citation: r for r in O.normalize_citations(df).collect()}
    # One field of each kind of dependency; each list is a plan of its own.
    for names in [["Chapter", "Series", "Date"], ["URL"], O.MINIMAL_FIELDS]:
        rows = O.normalize_citations(df, fields=names).collect()
        assert all(r[n] == whole[r.citation][n] for r in rows for n in names), names
        assert [c for c in rows[0].asDict() if c in O.FIELDS] == [f for f in O.FIELDS if f in names]


def test_fields_that_are_not_asked_are_not_planned(spark):
    df = spark.createDataFrame([("{{cite web|title=x}}",)], "citation string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    whole, few = plan(O.normalize_citations(df)), plan(O.normalize_citations(df, fields=O.MINIMAL_FIELDS))
    names = {f: "|".join(FIELD_ALIASES[f]) for f in ("Volume", "Edition", "Degree", "Title")}
    assert all(text in whole for text in names.values())
    assert [f for f, text in names.items() if text in few] == ["Title"]
    with pytest.raises(ValueError):
        O.normalize_citations(df, fields=["Nothing"])


def errors(spark, text):
    if "errors" not in _DONE:
        df = spark.createDataFrame([(t,) for t in _texts("errors")], "citation string")
        rows = Q.with_errors(O.parse_templates(df, "citation")).collect()
        _DONE["errors"] = {r.citation: set(r.errors) for r in rows}
    return _DONE["errors"][text]


def test_error_kinds(spark):
    assert errors(spark, "{{cite web|title=T|url=http://abc.org|date=2001}}") == set()
    assert {"bad_isbn", "bad_date", "cite_web_url"} <= errors(spark, "{{cite web|title=T|isbn=1|date=2001-13-01}}")
    assert {"contributor_missing_required_param"} <= errors(spark, "{{cite book|title=T|contributor=A|author=B}}")
    assert {"vancouver"} <= errors(spark, "{{cite book|title=T|vauthors=Doe John}}")
    assert {"empty_citation", "citation_missing_title"} <= errors(spark, "{{cite book}}")
    assert {"wikilink_in_url", "bad_url"} <= errors(spark, "{{cite web|title=T|url=[[x]]}}")
    assert {"param_has_ext_link"} <= errors(spark, "{{cite web|title=see http://abc.org|url=http://abc.org}}")
    assert {"invalid_param_val", "maint_english"} <= errors(spark, "{{cite book|title=T|mode=zz|language=English}}")
    assert {"archive_missing_date", "archive_missing_url"} <= errors(spark, "{{cite book|title=T|archive-url=http://abc.org}}")
    assert {"bad_paramlink"} <= errors(spark, "{{cite book|title=T|title-link=[[x]]}}")
    assert {"trans_missing_title"} <= errors(spark, "{{cite book|trans-title=T}}")


def test_redundant_params_are_sought_once_per_row(spark):
    """Only set names count, in the order of the field's names; the explode brings no filter that computes them again."""
    from refloom.operators import quality as Q

    maps = [
        (1, {"work": "b", "newspaper": "a", "title": "t", "url": ""}),
        (2, {"work": "", "newspaper": "a"}),
        (3, {"mailinglist": "m", "mailing-list": "n", "doi": "1", "DOI": "2"}),
        (4, {}),
        (5, None),
    ]
    found = Q.redundant_params(spark.createDataFrame(maps, "i int, params map<string,string>"))
    rows = sorted((r.i, r.field, r.chosen, r.ignored) for r in found.collect())
    assert rows == [
        (1, "Periodical", "newspaper", ["work"]), (3, "DOI", "doi", ["DOI"]), (3, "MailingList", "mailinglist", ["mailing-list"]),
    ]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_contains") == 1


def test_parameters_beside_control_characters(spark):
    """Marks that the parameter reader uses may stand in a text; the pattern is run once where they do not."""
    from refloom.functions import wikitext as W

    texts = [("{{cite web|title = a\x1eb|x\x1fy|url=[[p|q]]|=z}}",), ("{{cite web| title = a b |xy|url=[[p|q]]|n={{l|1}}|}}",), ("{{sfn}}",)]
    df = spark.createDataFrame(texts, "t string").select(W.template_params("t").alias("p"))
    got = [[(p.name, p.value, p.positional) for p in r.p] for r in df.collect()]
    assert got[0][:3] == [("title", "a\x1eb", False), ("1", "x\x1fy", True), ("url", "[[p|q]]", False)]
    assert got[1] == [("title", "a b", False), ("1", "xy", True), ("url", "[[p|q]]", False), ("n", "{{l|1}}", False), ("2", "", True)]
    assert got[2] == []
