"""Wikitext views over the driver tables, as SQL that Spark and DuckDB both run.

The tables hold no wikitext, so citations and articles are composed row by row from order lines and orders.
`cite_facts` keeps every composed part in its own column next to the finished citation text: Spark parses the
text, a check can read the parts. Both views are projections of one row of input each, so they need no shuffle
and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refloom.session import scratch_path, small_methods
from refloom.sources.dump import read_stage, spread, write_stage

_MONTHS = (
    "January February March April May June July August September October November December"
).split()

Q = "chr(39)"


def _choose(key: str, values: list[str], quoted: bool = True) -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + (f"'{v}'" if quoted else v) for i, v in enumerate(values)
    )
    return f"CASE {key} {arms} END"


def _month(m: str) -> str:
    return "CASE " + m + " " + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(_MONTHS)) + " END"


def _digit(number: str, place: int) -> str:
    return f"CAST(floor({number} / {10 ** place}) AS BIGINT) % 10"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _isbn13_check(nine: str) -> str:
    """Check digit of 978 followed by the nine digits of a number."""
    weights = [3, 1, 3, 1, 3, 1, 3, 1, 3]
    total = "38 + " + " + ".join(f"({_digit(nine, 8 - i)}) * {w}" for i, w in enumerate(weights))
    return f"(10 - ({total}) % 10) % 10"


def _issn_check(seven: str) -> str:
    total = " + ".join(f"({_digit(seven, 6 - i)}) * {8 - i}" for i in range(7))
    return f"(11 - ({total}) % 11) % 11"


# Template name by slot; slot 30 and 31 differ by order.
_SLOTS = (
    ["cite journal"] * 6 + ["cite book"] * 5 + ["cite web"] * 5 + ["cite news"] * 4
    + ["Cite Journal", " cite journal", "cite conference", "cite encyclopedia", "citation", "Citation",
       "cite arxiv", "cite thesis", "cite map", "cite episode"]
)
_RARE = ["cite techreport", "cite press release", "cite mailing list", "cite interview"]
_OTHER = ["sfn", "Infobox person", "cite tweet", "Harvnb"]

_BASE = """
SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln,
       CAST(l_quantity AS BIGINT) AS qty,
       CAST(year(l_shipdate) AS BIGINT) AS y, CAST(month(l_shipdate) AS BIGINT) AS m,
       CAST(day(l_shipdate) AS BIGINT) AS d
FROM {lineitem}
"""

_KEYS = """
SELECT b.*, (ok * 3 + pk * 5 + sk + ln) % 32 AS slot, (sk + ln) % 8 AS author_style, (pk + ln) % 14 AS date_style,
       (pk + 2 * sk + ok) % 12 AS id_style, (ok + sk) % 5 AS flaw, (ok + ln) % 8 AS title_style,
       (pk * 7919 + sk * 104729) % 1000000000 AS nine, (pk * 31 + sk * 7) % 10000000 AS seven
FROM base b
"""

_PLAIN_TITLE = "'Study ' || " + _s("pk") + " || ' of ' || " + _choose(
    "sk % 5", ["rivers", "castles", "birds", "engines", "poems"]
)

_DAY2 = "lpad(" + _s("d") + ", 2, '0')"
_MON2 = "lpad(" + _s("m") + ", 2, '0')"
_DATE_STYLES = [
    f"{_s('y')} || '-' || {_MON2} || '-' || {_DAY2}",
    f"{_month('m')} || ' ' || {_s('d')} || ', ' || {_s('y')}",
    f"{_s('d')} || ' ' || {_month('m')} || ' ' || {_s('y')}",
    f"{_month('m')} || ' ' || {_s('y')}",
    _s("y"),
    f"CASE m % 4 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' ELSE 'Autumn' END || ' ' || {_s('y')}",
    f"'c. ' || {_s('y')}",
    "'n.d.'",
    f"{_s('y')} || '-' || {_MON2}",
    f"{_s('y')} || '–' || {_s('y + 1')}",
    f"'3–' || {_s('4 + d')} || ' ' || {_month('m')} || ' ' || {_s('y')}",
    f"'February 30, ' || {_s('y')}",
    f"'Winter ' || {_s('y')} || '–' || substring({_s('y + 1')}, 3, 2)",
    "CAST(NULL AS STRING)",
]

_LAST = "substring('ABCDEFGHJK', 1 + CAST({k} % 10 AS INT), 1) || 'son' || " + _s("{k} % 100")

_FACTS = f"""
SELECT k.*,
  CASE WHEN slot < 30 THEN {_choose('slot', _SLOTS)}
       WHEN slot = 30 THEN {_choose('ok % 4', _RARE)} ELSE {_choose('pk % 4', _OTHER)} END AS name,
  {_PLAIN_TITLE} AS plain_title,
  CASE title_style WHEN 0 THEN {Q} || {Q} || {_PLAIN_TITLE} || {Q} || {Q}
       WHEN 1 THEN '[[Topic ' || {_s('pk')} || '|' || {_PLAIN_TITLE} || ']]'
       WHEN 2 THEN {_PLAIN_TITLE} || ' ««lang|fr|mot ' || {_s('sk')} || '»»'
       ELSE {_PLAIN_TITLE} END AS title,
  CASE WHEN slot < 6 OR slot IN (20, 21) THEN {_choose('sk % 3', [
      "'[[Journal of J' || " + _s('sk % 20') + " || ']]'", "'Annals N' || " + _s('sk % 20'), "'[[Rev|Review 7]]'"
  ], quoted=False)} END AS journal,
  CASE WHEN slot BETWEEN 16 AND 19 THEN 'Daily ' || {_s('sk % 40')} END AS newspaper,
  CASE WHEN slot BETWEEN 16 AND 19 AND pk % 7 = 0 THEN 'Other' END AS work,
  CASE WHEN slot BETWEEN 11 AND 15 THEN 'Site ' || {_s('sk % 60')} END AS website,
  CASE WHEN slot = 23 THEN 'Enc ' || {_s('sk')} END AS encyclopedia,
  CASE WHEN slot = 22 THEN 'Conf ' || {_s('sk % 9')} END AS conference,
  CASE WHEN slot = 22 AND pk % 2 = 0 THEN 'Proc ' || {_s('sk % 9')} END AS book_title,
  CASE WHEN slot BETWEEN 6 AND 10 THEN CASE WHEN sk % 2 = 0 THEN '[[Press ' || {_s('sk')} || ']]'
       ELSE 'Press ' || {_s('sk')} END END AS publisher,
  CASE WHEN slot < 11 THEN {_s('qty')} END AS volume,
  CASE WHEN slot < 20 THEN {_s('ln')} END AS issue,
  CASE WHEN slot BETWEEN 6 AND 10 THEN CASE WHEN pk % 3 = 0 THEN 'p. ' || {_s('qty')} ELSE {_s('qty')} END END AS page,
  CASE WHEN slot < 6 THEN {_s('qty')} || CASE WHEN ok % 2 = 0 THEN '–' ELSE '-' END || {_s('qty + 9')} END AS pages,
  {_choose('date_style', _DATE_STYLES, quoted=False)} AS date,
  CASE WHEN date_style = 13 OR date_style = 0 AND sk % 3 = 0 THEN {_s('CASE WHEN sk % 2 = 0 THEN y ELSE y - 1 END')} END AS year,
  {_LAST.format(k='sk')} AS last1, 'F. ' || {_s('pk % 50')} AS first1,
  {_LAST.format(k='pk')} AS last2, 'G' AS first2,
  CASE WHEN id_style IN (0, 1, 2, 3) THEN CASE WHEN flaw = 0 THEN '10.' || {_s('1000 + sk')} || '/x.' || {_s('ok')} || '.'
       WHEN flaw = 1 THEN '10.' || {_s('1000 + sk')} || '/a,b:c=' || {_s('ok')}
       ELSE '10.' || {_s('1000 + sk')} || '/x.' || {_s('ok')} || '.' || {_s('pk')} END END AS doi,
  CASE WHEN id_style IN (2, 3, 4, 5, 6) THEN '978-' || lpad({_s('nine')}, 9, '0') || '-' ||
       {_s('CASE WHEN flaw = 0 THEN ((' + _isbn13_check('nine') + ') + 1) % 10 ELSE ' + _isbn13_check('nine') + ' END')}
       END AS isbn,
  CASE WHEN id_style = 9 THEN lpad({_s('CAST(floor(seven / 1000) AS BIGINT)')}, 4, '0') || '-' || lpad({_s('seven % 1000')}, 3, '0') ||
       CASE WHEN flaw = 0 THEN CASE {_issn_check('seven')} WHEN 5 THEN '6' ELSE '5' END
            WHEN {_issn_check('seven')} = 10 THEN 'X' ELSE {_s(_issn_check('seven'))} END END AS issn,
  CASE WHEN id_style IN (1, 7) THEN CASE WHEN flaw = 0 THEN {_s('30000001 + pk')} WHEN flaw = 1 THEN 'PMID' || {_s('pk')}
       ELSE {_s('sk * 1000 + pk + 1')} END END AS pmid,
  CASE WHEN id_style = 8 THEN CASE WHEN flaw = 0 THEN {_s('5000001 + pk')} ELSE {_s('sk * 100 + pk + 1')} END END AS pmc,
  CASE WHEN slot = 26 THEN CASE WHEN flaw = 0 THEN '0613.' || lpad({_s('pk % 10000')}, 4, '0')
       WHEN flaw = 1 THEN 'hep-th/' || lpad({_s('90 + pk % 10')}, 2, '0') || {_MON2} || lpad({_s('sk % 1000')}, 3, '0')
       WHEN flaw = 2 THEN '15' || {_MON2} || '.' || lpad({_s('pk % 100000')}, 5, '0') || 'v2'
       ELSE '08' || {_MON2} || '.' || lpad({_s('pk % 10000')}, 4, '0') END END AS arxiv,
  CASE WHEN id_style = 10 THEN CASE flaw WHEN 0 THEN 'abc' || {_s('pk')} WHEN 1 THEN 'n' || lpad({_s('pk')}, 8, '0')
       WHEN 2 THEN 'n78-' || {_s('pk')} WHEN 3 THEN lpad({_s('pk')}, 8, '0') || '/x' ELSE 'n ' || lpad({_s('pk')}, 8, '0') END END AS lccn,
  CASE WHEN id_style = 11 AND slot BETWEEN 6 AND 10 THEN {_s('pk + 1')} || CASE flaw WHEN 0 THEN 'Z' WHEN 1 THEN 'A' WHEN 2 THEN 'M' ELSE 'W' END END AS ol,
  CASE WHEN slot BETWEEN 11 AND 19 OR slot = 27 THEN CASE pk % 6
       WHEN 0 THEN 'http://www.site' || {_s('sk % 60')} || '.co.uk/a/' || {_s('ok')}
       WHEN 1 THEN 'https://www.youtube.com/user/site' || {_s('sk % 60')}
       WHEN 2 THEN 'https://books.google.com/books?id=' || {_s('ok')}
       WHEN 3 THEN 'https://news.site' || {_s('sk % 60')} || '.org/f.pdf'
       WHEN 4 THEN 'https://www.site' || {_s('sk % 60')} || '.com/a b'
       ELSE 'https://site' || {_s('sk % 60')} || '.com' END END AS url,
  CASE WHEN slot BETWEEN 11 AND 19 OR slot = 27 THEN CASE WHEN pk % 6 = 2 THEN 'google' ELSE 'site' || {_s('sk % 60')} END ELSE '' END AS domain,
  CASE WHEN slot BETWEEN 11 AND 19 THEN {_s('2000 + pk % 40')} || '-0' || {_s('1 + sk % 9')} || '-15' END AS access_date,
  CASE WHEN pk % 25 = 0 THEN 'Rare' END AS unknown_value,
  CASE WHEN pk % 31 = 0 THEN 'Caps' END AS caps_value,
  CASE WHEN pk % 37 = 0 THEN 'Doe, J.' END AS coauthors
FROM keys k
"""


def _param(name: str, value: str) -> str:
    """`|name=value` or nothing when the value is null; blanks around the signs on every third order."""
    spaced = f"CASE WHEN ok % 3 = 0 THEN ' | ' || {name} || ' = ' ELSE '|' || {name} || '=' END"
    return f"coalesce({spaced} || {value}, '')"


def _bare_param(name: str, value: str) -> str:
    return f"coalesce('|' || {name} || '=' || {value}, '')"


_AUTHORS = f"""CASE WHEN slot = 31 THEN '' ELSE CASE author_style
  WHEN 0 THEN '|last1=' || last1 || '|first1=' || first1 || '|last2=' || last2 || '|first2=' || first2
  WHEN 1 THEN '|author1=' || last1 || '|author2=' || last2 || ' et al.'
  WHEN 2 THEN '|vauthors=' || last1 || ' AB, ' || last2 || ' C, ((Corp ' || {_s('sk')} || '))'
  WHEN 3 THEN '|authors=' || last1 || ' and ' || last2
  WHEN 4 THEN '|last=' || last1 || '|first=' || first1 || '|author-link=Page ' || {_s('sk')}
  WHEN 5 THEN ''
  WHEN 6 THEN '|last1=' || last1 || '|first2=' || first2 || '|last3=' || last2 || '|last6=Late'
  ELSE '|first=' || first1 || '|last=' || last1 || '|editor-last=' || last2 || '|editor-first=' || first2 END END"""

_PARAMS = [
    ("'title'", "title"),
    ("CASE WHEN slot = 20 THEN 'work' WHEN ok % 2 = 0 THEN 'journal' ELSE 'periodical' END", "journal"),
    ("'newspaper'", "newspaper"),
    ("'work'", "work"),
    ("'website'", "website"),
    ("'encyclopedia'", "encyclopedia"),
    ("'conference'", "conference"),
    ("'book-title'", "book_title"),
    ("'publisher'", "publisher"),
    ("'volume'", "volume"),
    ("CASE WHEN ok % 2 = 0 THEN 'issue' ELSE 'number' END", "issue"),
    ("'page'", "page"),
    ("'pages'", "pages"),
    ("'date'", "date"),
    ("'year'", "year"),
    ("CASE WHEN ok % 2 = 0 THEN 'doi' ELSE 'DOI' END", "doi"),
    ("CASE WHEN ok % 4 = 0 THEN 'isbn13' ELSE 'isbn' END", "isbn"),
    ("'issn'", "issn"),
    ("'pmid'", "pmid"),
    ("'pmc'", "pmc"),
    ("CASE WHEN ok % 2 = 0 THEN 'arxiv' ELSE 'eprint' END", "arxiv"),
    ("'lccn'", "lccn"),
    ("'ol'", "ol"),
    ("'url'", "url"),
    ("CASE WHEN ok % 2 = 0 THEN 'access-date' ELSE 'accessdate' END", "access_date"),
    ("'foo'", "unknown_value"),
    ("'Publisher'", "caps_value"),
    ("'coauthors'", "coauthors"),
]


def params_text(param=_bare_param, changed: dict[str, str] | None = None) -> str:
    """All parameters of a citation as text; `changed` gives other SQL for the value of some columns."""
    change = changed or {}
    listed = " || ".join(param(name, change.get(value, value)) for name, value in _PARAMS)
    unnamed = "'|' || last1 || '|' || " if param is _param else "'|1=' || last1 || '|2=' || "
    return (
        f"{_AUTHORS} || CASE WHEN slot = 31 THEN {unnamed}{_s('y')} ELSE "
        f"CASE WHEN pk % 11 = 0 THEN '|title=Draft' ELSE '' END || {listed} END"
    )


_CITATION = " || ".join(
    [
        "'««' || name",
        "CASE WHEN ok % 13 = 0 THEN chr(10) ELSE '' END",
        params_text(_param),
        "CASE WHEN ok % 17 = 0 THEN '' ELSE '»»' END",
    ]
)

CITE_FACTS = f"""
WITH base AS ({_BASE}), keys AS ({_KEYS}), facts AS ({_FACTS})
SELECT f.ok AS page_id, f.*, {_CITATION} AS citation,
       {params_text()} AS params_text,
       'Page ' || {_s('ok')} AS page_title, CASE ln % 4 WHEN 0 THEN 'Initial Section' WHEN 1 THEN 'History'
       WHEN 2 THEN 'References' ELSE 'Section ' || {_s('sk % 30')} END AS section
FROM facts f
"""

# --- articles ----------------------------------------------------------------------------------------------


class Piece:
    """Part of an article: its text, when it is there, and what it holds.

    `parts` are SQL texts; a part wrapped in `T` is a template. Everything a check wants to know about a piece is
    stated next to it.
    """

    def __init__(self, *parts, cond="TRUE", section=None, strict=None, nested=(), links=(), urls=(), heading=None,
                 items=(), cells=(), plain=None):
        self.parts, self.cond, self.section, self.strict = parts, cond, section, strict or section
        self.nested, self.links, self.urls, self.heading = nested, links, urls, heading
        self.items, self.cells, self.plain = items, cells, plain

    @property
    def text(self) -> str:
        return " || ".join(p.sql if isinstance(p, T) else p for p in self.parts)

    @property
    def templates(self) -> list[str]:
        return [p.sql for p in self.parts if isinstance(p, T)]


class T:
    def __init__(self, sql: str):
        self.sql = sql


_N = _s("ok")
_C = _s("ck")
_ISO = f"{_s('y')} || '-' || {_MON2} || '-' || {_DAY2}"

LANG = f"'««lang|la|rex ' || {_N} || '»»'"
PAPER = (
    f"'««cite journal|last=Kim|first=A.|title=Paper ' || {_N} || '|journal=Annals ' || {_C} ||"
    f" '|doi=10.' || {_s('1000 + ck')} || '/' || {_N} || '|date=' || {_ISO} || '»»'"
)
SFNREF = f"'««sfnref|Lee|' || {_s('y')} || '»»'"
BOOK = f"'««cite book|last=Lee|title=Book ' || {_C} || '|isbn=9780306406157|ref=' || {SFNREF} || '»»'"
WEB = (
    f"'««cite web|title=Web ' || {_N} || '|url=https://www.site' || {_s('ck % 60')} ||"
    f" '.com/' || {_N} || '|website=Site ' || {_s('ck % 60')} || '»»'"
)
NEWS = (
    f"'««Cite news |title=News ' || {_C} || ' |url=http://news.site' || {_s('ck % 90')} ||"
    f" '.org/x |newspaper=Daily ' || {_s('ck % 40')} || '»»'"
)
ARGUMENT = f"'«««label|none ' || {_N} || '»»»'"


LEAD, HISTORY, EARLY, REFERENCES = "Initial Section", "History", "Early years", "References"

PIECES = [
    Piece(f"{Q} || {Q} || {Q} || 'Page ' || {_N} || {Q} || {Q} || {Q} || ' is about '",
          plain=f"'Page ' || {_N} || ' is about '"),
    Piece(T(LANG), section=LEAD, plain="''"),
    Piece(f"' and [[Topic ' || {_C} || '|topic ' || {_C} || ']] and [[Topic ' || {_N} || ']].'",
          links=[(f"'Topic ' || {_C}", f"'topic ' || {_C}"), (f"'Topic ' || {_N}", "CAST(NULL AS STRING)")],
          plain=f"' and topic ' || {_C} || ' and Topic ' || {_N} || '.'"),
    Piece(f"'<ref name=\"r' || {_N} || '\">'", T(PAPER), "'</ref>'", cond="ok % 3 <> 0", section=LEAD, plain="''"),
    Piece(f"'<!-- old ««cite web|title=Gone ' || {_N} || '»» -->'", cond="ok % 4 = 0", plain="''"),
    Piece("chr(10) || '== History ==' || chr(10)", heading=(2, "History"),
          plain="chr(10) || ' History ' || chr(10)"),
    Piece(
        f"'Seen at [https://www.site' || {_s('ck % 60')} || '.com/p site ' || {_N} || '] and"
        f" https://bare.example.org/' || {_N} || ' in year ' || {_s('y')} || '.'",
        urls=[
            (f"'https://www.site' || {_s('ck % 60')} || '.com/p'", f"'site ' || {_N}"),
            (f"'https://bare.example.org/' || {_N}", "CAST(NULL AS STRING)"),
        ],
        plain=f"'Seen at site ' || {_N} || ' and https://bare.example.org/' || {_N} || ' in year ' || {_s('y')} || '.'",
    ),
    Piece("'<ref>'", T(BOOK), "'</ref>'", cond="ok % 5 <> 1", section=HISTORY, nested=[SFNREF], plain="''"),
    Piece("chr(10) || '=== Early years ===' || chr(10)", cond="ok % 2 = 0", heading=(3, "Early years"),
          plain="chr(10) || ' Early years ' || chr(10)"),
    Piece("'Rather, early | words ~ here. '", T(WEB), cond="ok % 2 = 0", section=EARLY, strict=HISTORY,
          plain="'Rather, early | words ~ here. '"),
    Piece("' Again '", T(PAPER), cond="ok % 6 = 1", section=HISTORY, plain="' Again '"),
    Piece("'<nowiki>««not a template»»</nowiki>'", cond="ok % 7 = 0", plain="'««not a template»»'"),
    Piece("chr(10) || '==Notes==' || chr(10) || 'Plain &amp; &eacute; &#233; &#x41;.'", cond="ok % 10 = 3",
          heading=(2, "Notes"), plain="chr(10) || 'Notes' || chr(10) || 'Plain & é é A.'"),
    Piece("chr(10) || '== References ==' || chr(10)", heading=(2, "References"),
          plain="chr(10) || ' References ' || chr(10)"),
    Piece("'* '", T(NEWS), f"chr(10) || '# item ' || {_N} || chr(10) || '; term : ' || {_C} || chr(10)",
          section=REFERENCES,
          items=[("'*'", "'li'", NEWS), ("'#'", "'li'", f"'item ' || {_N}"), ("';'", "'dt'", f"'term : ' || {_C}")],
          plain=f"' ' || chr(10) || ' item ' || {_N} || chr(10) || ' term : ' || {_C} || chr(10)"),
    Piece(ARGUMENT, cond="ok % 8 = 0", plain=f"'none ' || {_N}"),
    Piece(
        "chr(10) || '«| class=\"wikitable\"' || chr(10) || '|-' || chr(10) || '! a !! b' || chr(10) || '|-' || chr(10)"
        f" || '| ' || {_N} || ' || ' || {_C} || chr(10) || '|»' || chr(10)",
        cond="ok % 9 = 0",
        cells=[(1, 1, "TRUE", "'a'"), (1, 2, "TRUE", "'b'"), (2, 1, "FALSE", _N), (2, 2, "FALSE", _C)],
        plain=f"chr(10) || chr(10) || chr(10) || ' a  b' || chr(10) || chr(10) || ' ' || {_N} || '  ' || {_C} || chr(10) || chr(10)",
    ),
    Piece(f"' ««open ' || {_N}", cond="ok % 11 = 0", plain=f"' ««open ' || {_N}"),
]

_ARTICLE_BASE = """
SELECT o_orderkey AS ok, o_custkey AS ck, CAST(year(o_orderdate) AS BIGINT) AS y,
       CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d
FROM {orders}
"""

_CONTENT = " || ".join(
    p.text if p.cond == "TRUE" else f"CASE WHEN {p.cond} THEN {p.text} ELSE '' END" for p in PIECES
)


ARTICLES = (
    f"WITH a AS ({_ARTICLE_BASE}) SELECT ok AS page_id, 'Page ' || {_N} AS title, {_CONTENT} AS content,"
    " ok * 10 AS r_id, ok * 10 - 1 AS r_parentid FROM a"
)


TABLES = ("lineitem", "orders", "pages", "supplier", "part", "documents", "customer", "events")


def _braces(sql: str) -> str:
    """Wiki braces are written « and » so that they cannot be taken for table placeholders."""
    return sql.replace("«", "{{").replace("»", "}}")


# --- lists and outside records -------------------------------------------------------------------------------

# Lines of a list of news sites, `Name (address)` or a bare address.
NEWS_LIST = f"""
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Paper ' || {_s('s_suppkey')} || ' (www.site' || {_s('s_suppkey')} || '.com)'
       WHEN s_suppkey % 5 = 1 THEN 'no address ' || {_s('s_suppkey')}
       ELSE 'site' || {_s('s_suppkey')} || '.co.uk' END AS value
FROM {{supplier}} WHERE s_suppkey % 3 = 0
"""

_RECORD_TITLE = "'Study ' || " + _s("p_partkey") + " || ' of ' || " + _choose(
    "p_partkey % 5", ["rivers", "castles", "birds", "engines", "poems"]
)


def _volume(title: str, ids: str = "") -> str:
    more = f" || ',\"industryIdentifiers\":[' || {ids} || ']'" if ids else ""
    return f"'«\"volumeInfo\":«\"title\":\"' || {title} || '\"'{more} || '»»'"


def _identifier(kind: str, value: str) -> str:
    return f"'«\"type\":\"{kind}\",\"identifier\":\"' || {value} || '\"»'"


_ISBN_ID = _identifier("ISBN_13", "'978' || lpad(" + _s("pk") + ", 10, '0')")
_OTHER_ID = _identifier("OTHER", "'X' || " + _s("pk"))

# One response per catalogue and title; `pk` decides which shape it has.
RECORDS = f"""
WITH r AS (SELECT p_partkey AS pk, {_RECORD_TITLE} AS query_title FROM {{part}})
SELECT pk, query_title,
  CASE pk % 6
    WHEN 0 THEN '«\"items\":[' || {_volume('query_title', _ISBN_ID)} || ']»'
    WHEN 1 THEN '«\"items\":[' || {_volume("query_title || ' x'", _OTHER_ID)} || ',' || {_volume('query_title', _ISBN_ID)} || ']»'
    WHEN 2 THEN '«\"items\":[' || {_volume("'%%%%%%%%'", _OTHER_ID)} || ',' || {_volume('query_title', _ISBN_ID)} || ']»'
    WHEN 3 THEN '«\"items\":[' || {_volume('query_title')} || ']»'
    WHEN 4 THEN '«\"totalItems\":0»'
    ELSE '«\"items\":[' || {_volume("query_title || 'abc'", _ISBN_ID + " || ',' || " + _OTHER_ID)} || ',' || {_volume("'%%%%%%%%'", _OTHER_ID)}
         || ',' || {_volume('query_title', _OTHER_ID)} || ']»' END AS books,
  CASE pk % 4
    WHEN 0 THEN '«\"message\":«\"items\":[«\"DOI\":\"10.5/' || {_s('pk')} || '\",\"title\":[\"' || query_title || '\"]»]»»'
    WHEN 1 THEN '«\"message\":«\"items\":[«\"DOI\":\"10.6/' || {_s('pk')} || '\",\"title\":[\"%%%%%%%%\"]»,«\"DOI\":\"10.7/' || {_s('pk')} || '\",\"title\":[\"' || query_title || '\"]»]»»'
    WHEN 2 THEN '«\"message\":«\"items\":[]»»'
    ELSE '«\"message\":«\"items\":[«\"DOI\":\"10.8/' || {_s('pk')} || '\",\"ISBN\":[\"1\",\"2\"],\"PMID\":\"' || {_s('pk')} || '\",\"title\":[\"' || query_title || 'zz\"]»]»»' END AS works
FROM r
"""


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view in Spark. The small driver files give few tasks, so their rows are spread over the cores first."""
    frames = {
        t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES if "{" + t + "}" in sql
    }
    return spark.sql(_braces(sql), **frames)


def duck(sql: str) -> str:
    """The same text for DuckDB, where the tables are views of that name."""
    return _braces(sql).format(**{t: t for t in TABLES})


def duck_pieces(select: str) -> str:
    """Rows about the pieces of all articles for DuckDB: `select` is called with ok, ck, y, m, d in scope."""
    return duck(f"WITH a AS ({_ARTICLE_BASE}) {select}")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _stage(spark: SparkSession, sf_dir: str, name: str, sql: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A view written once per application as a stage table in the shared folder, the way the pipeline's own
    stages follow each other; queries then read what they need of it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        view = spark_view(spark, sf_dir, sql)
        path = scratch_path(spark, name)
        with small_methods(spark):
            write_stage(view.select(*columns) if columns else view, path)
        _WRITTEN[key] = path
    return read_stage(spark, _WRITTEN[key])


def cite_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts and the citation text, for tests."""
    return spark_view(spark, sf_dir, CITE_FACTS)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, page_title, section, citation: one row per order line."""
    return _stage(spark, sf_dir, "citations", CITE_FACTS, ("page_id", "page_title", "section", "citation"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, title, content, r_id, r_parentid: one row per order."""
    return _stage(spark, sf_dir, "articles", ARTICLES)


def news_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a list of news sites: value."""
    return spark_view(spark, sf_dir, NEWS_LIST)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue responses per title: pk, query_title, books, works."""
    return spark_view(spark, sf_dir, RECORDS)
