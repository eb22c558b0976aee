import datetime

import pytest
from pyspark.sql import functions as F

from refloom.functions import citation as C
from refloom.functions import dates as D
from refloom.functions import fields as FD
from refloom.functions import identifiers as I
from refloom.functions import names as N
from refloom.functions import urls as U
from refloom.tables import params as P


def test_param_tables_are_consistent():
    assert len(P.ID_KINDS) == 20
    assert "access-date" in P.KNOWN_PARAMS and "accessdate" in P.KNOWN_PARAMS
    assert P.FIELD_ALIASES["ChapterURL"][:2] == ["chapter-url", "chapterurl"]


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (I.valid_isbn, ["978-0821369418", "0-306-40615-2", "080442957X"], ["978-0821369419", "123", "97808213694a8"]),
        (I.valid_issn, ["0002-9890", "2434-561X"], ["00029891", "0002-989"]),
        (I.valid_ismn, ["979-0-2600-0043-8"], ["978-0-2600-0043-8"]),
        (I.valid_doi, ["10.1016/s1097-2765(00)80111-2", "10.1/a,b"], ["10.1/a.", "10.1/a b", "11.1/x", "10.1"]),
        (I.valid_pmid, ["1", "30000000"], ["0", "30000001", "PMID1", "99999999999999999999"]),
        (I.valid_pmc, ["5000000"], ["5000001", "PMC1"]),
        (I.valid_arxiv, ["hep-th/9901001", "math.GT/0309136v1", "0704.0001", "1501.00001v2"],
         ["0703.0001", "hep-th/0704001", "hep-th/9101001", "1413.0001", "x"]),
        (I.valid_lccn, ["85000002", "n78890351", "n78-890351", "ab1234567890"], ["a1", "n 78890351", "ABC12345678"]),
        (I.valid_asin, ["B00005N5PF", "0306406152"], ["0306406153", "B0000", "1ABCDEFGHI"]),
        (I.valid_ol, ["123M", "5W"], ["123", "M1"]),
        (I.valid_message_id, ["a@b"], ["<a@b>", "ab"]),
        (U.valid_url, ["http://abc.com/x", "//x.org", "https://1.2.3.4/y"], ["foo", "http://a b.com", "http:///abc.com", "http://a.com"]),
        (U.has_external_link, ["see http://abc.com/x", "[//abc.org t]"], ["plain", "[[Page]]", "a: b"]),
        (U.link_param_ok, ["Page name"], ["[[Page]]", "http://abc.com"]),
        (U.is_pdf, ["http://a/b.pdf", "x.PDF?y=1", "x.pdf#p"], ["x.pdfs", "pdf"]),
        (FD.extra_page_text, ["p. 5", "pp. 5", "page 3", "p4"], ["P7", "P 4", "5", "abc"]),
    ],
)
def test_checks(one, check, good, bad):
    assert one(check("t"), good + bad) == [True] * len(good) + [False] * len(bad)


def test_number_forms(one):
    assert one(I.normalize_lccn("t"), ["n78-890351", "85-2 /x"]) == ["n78890351", "85000002"]
    assert one(I.format_issn("t"), ["00029890", "bad"]) == ["0002-9890", "bad"]
    assert one(I.clean_isbn("t"), ["ISBN 0-306 X"]) == ["0-306X"]
    assert one(I.id_url(F.lit("OL"), "t"), ["5W"]) == ["//openlibrary.org/works/OL5W"]
    assert one(I.id_url(F.lit("ASIN"), "t", F.lit("uk")), ["B1"]) == ["//www.amazon.co.uk/dp/B1"]


DATES = {
    "2001-02-28": "2001-02-28", "2001-02-30": None, "1582-01-01": None, "March 5, 2001": "2001-03-05",
    "5 Mar 2001": "2001-03-05", "5–7 March 2001": "2001-03-05/2001-03-07", "7–5 March 2001": None,
    "March 5–7, 2001": "2001-03-05/2001-03-07", "March 2001": "2001-03", "march 2001": None, "Spring 2001": "2001",
    "Spring–Summer 2001": "2001", "Summer–Spring 2001": None, "Fall–Winter 2001": "2001",
    "Jan–March 2001": None, "May–June 2001": "2001-05/2001-06", "Winter 2001–02": "2001/2002",
    "Winter 1999–00": None, "Winter 2001–2002": "2001/2002", "Fall 2001 – Spring 2002": "2001/2002",
    "May 2001 – June 2002": "2001-05/2002-06", "2001–2002": "2001/2002", "2001–05": None, "2001–15": "2001/2015",
    "950": "950", "900–950": "0900/0950", "2001a": "2001", "Christmas 1999": "1999", "3001": None,
    "5 March – 6 April 2001": "2001-03-05/2001-04-06", "March 5 – April 6, 2001": "2001-03-05/2001-04-06",
    "12 Feb 2000 – 1 Mar 2001": "2000-02-12/2001-03-01",
    "January 31, 2000 – March 1, 2001": "2000-01-31/2001-03-01", "29 February 1500": "1500",
    "29 February 1900": None, "31 April 2000": None, "nonsense": None,
}


def test_dates(one):
    assert one(D.iso_date("t", 2026), list(DATES)) == list(DATES.values())


def test_date_details(one):
    got = one(D.parse_date("t", 2026), ["Fall 2001 – Spring 2002", "Christmas 1999", "5–7 March 2001", None])
    assert (got[0].chron, got[0].season) == ("fall 2001 – spring 2002", "fall")
    assert (got[1].chron, got[1].season) == ("Christmas", None)
    assert (got[2].start, got[2].finish) == (datetime.date(2001, 3, 5), datetime.date(2001, 3, 7))
    assert got[3] is None
    assert one(D.acceptable_date("t", 2026), ["c. 1900", "n.d.", "nd", "c. 2900", "2001-13-01"]) == [
        True, True, True, False, False]
    assert one(D.year_date_mismatch(F.lit("2001"), "t"), ["2001-02-03", "March 2002", "2000–2001", "2000–01", "x"]) == [
        1, 0, 1, 1, 1]
    assert one(D.year_date_mismatch(F.lit("2001a"), "t"), ["2001-02-03", "2002-02-03"]) == [2, 0]


def test_names(over):
    got = over(N.authors("m"), [
        {"last1": "A", "first1": "B", "last3": "C et al.", "first2": "zz", "author-link": "L"},
        {"author": "X", "last2": "Y", "last5": "Q"},
        {"vauthors": "Laherty CD, Van Billin AN, ((Corp X)), Solo"},
        {"authors": "p"}, {},
        {"author1-last": "P", "author-first1": "Q", "author-mask1": "2"},
    ])
    flat = [[(p.last, p["first"]) for p in g] for g in got]
    assert flat == [
        [("A", "B"), ("C", None)], [("X", None), ("Y", None)],
        [("Laherty", "CD"), ("Van Billin", "AN"), ("Corp X", ""), ("Solo", "")], [], [], [("P", "Q")]]
    assert got[0][0].link == "L" and got[5][0].mask == "2"
    assert over(N.author_source("m"), [{"last1": "A", "vauthors": "B"}, {"vauthors": "B", "authors": "C"}, {"authors": "C"}, {}]) == [
        "numbered", "vancouver", "text", "none"]
    assert over(N.people_text(N.authors("m", free_text=True)), [{"authors": "p and q"}]) == ["p and q"]


def test_et_al(one):
    assert one(N.strip_et_al("t"), ["Doe, et al.", "Doe and others", "Petal", "Doe ''et al.''"]) == ["Doe", "Doe", "Petal", "Doe"]


def test_text_rules(one):
    assert one(FD.clean_pages("t"), ["[http://x.y 12]–15 [[a]]", "12&ndash;15"]) == ["12-15 a", "12-15"]
    assert one(FD.hyphen_to_dash("t"), ["1-2", "[1-2]"]) == ["1–2", "[1-2]"]
    assert one(FD.coins_title("t", F.lit("ja: x")), ["''A''", None]) == ["A x", "x"]
    assert one(FD.clean_invisible("t"), ["a​b c­"]) == ["ab c"]
    (hits,) = one(FD.invisible_chars("t"), ["ab​c\td"])
    assert [(h.group, h.position) for h in hits] == [("zero width space", 3), ("horizontal tab", 5)]
    assert one(FD.csv_array("t"), ["['a','b c']\n"]) == [["a", "b c"]]
    assert one(FD.legacy_id_pairs("t"), ["{'DOI': '10.1/a,b:c=d', 'PMID': '3'}", "{DOI=10.1/a,b=c, PMID=3}", ""]) == [
        {"DOI": "10.1/a,b:c=d", "PMID": "3"}, {"DOI": "10.1/a,b=c", "PMID": "3"}, {}]


def test_domains(one):
    assert one(U.top_domain("t"), [
        "https://www.bbc.co.uk/news", "http://www.nytimes.com", "https://www.youtube.com/user/cnn", "", "localhost",
        "https://m.foo.example.com:80/x", None,
    ]) == ["bbc", "nytimes", "cnn", "", "localhost", "example", ""]


def test_types_and_classes(one):
    names = ["cite press release", "Cite book", "Citation", "Harvnb", "Cite AV media notes", "London Gazette"]
    assert one(C.citation_class("t"), names) == ["pressrelease", "book", "citation", "harvnb", "AV-media-notes", "gazette"]
    assert one(C.citation_class("t", strict=True), names) == ["release", "book", "Citation", "harvnb", "notes", "gazette"]
    assert one(C.is_citation_template("t", strict=True), ["cite arxiv", "cite arXiv", "Cite book", "cite Book"]) == [
        False, True, True, False]
    assert one(C.is_citation_template("t", "it"), ["cita pubblicazione", "cite book"]) == [True, False]
    assert one(C.citation_type("t"), ["{{ cite journal|a", "{{Cite book\n|x", "{{cite web}}"]) == ["cite journal", "cite book", "cite web"]
    assert one(C.citation_type("t", strict=True), ["{{ cite journal|a"]) == [" cite journal"]
    assert one(C.title_type("t", F.lit(None).cast("string"), F.lit("PhD")), ["thesis", "map", "book"]) == ["PhD thesis", "Map", None]
    assert one(C.gazette_city(F.lit("gazette"), "t"), ["e", None, "Paris"]) == ["Edinburgh", "London", "London"]


@pytest.mark.parametrize(
    "cls, given, expected",
    [
        ("harvnb", {"1": "Smith", "2": "2007a"}, {"last1": "Smith", "year": "2007a"}),
        ("nrisref", {"name": "N", "refnum": "7", "version": "2010a"}, {"title": "N", "seriesno": "7", "series": "2010a"}),
        ("gnis", {"1": "123", "2": "Some place", "3": "2001-02-03"}, {"seriesno": "123", "title": "Some place", "accessdate": "2001-02-03"}),
        ("season", {"1": "2001–2002", "2": "77", "name": "X"}, {"year": "2001–2002", "seriesno": "77", "title": "X"}),
        ("sports-reference", {"1": "T", "2": "u", "3": "d"}, {"title": "T", "url": "u", "accessdate": "d"}),
        ("nhle", {"num": "1", "desc": "D"}, {"seriesno": "1", "title": "D"}),
        ("book", {"1": "x"}, {"1": "x"}),
    ],
)
def test_positional_parameters(over, cls, given, expected):
    assert over(C.remap_positional(F.lit(cls), "m", 2026), [given]) == [expected]
