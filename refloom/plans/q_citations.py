"""Queries over citation texts: types, parameters, normalised fields, identifiers, dates, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions import citation as C
from refloom.functions import dates as DT
from refloom.functions import fields as FD
from refloom.functions import identifiers as I
from refloom.functions import names as N
from refloom.functions import urls as U
from refloom.functions import wikitext as W
from refloom.functions.core import settle
from refloom.operators import citations as O
from refloom.operators import extraction as X
from refloom.operators import labels as L
from refloom.operators import quality as Q
from refloom.operators import rewriting as R
from refloom.plans import derived as D
from refloom.plans.registry import query
from refloom.tables.params import FIELD_ALIASES, ID_KINDS
from refloom.tables.templates import CITATION_TYPES

FACTS = f"({D.duck(D.CITE_FACTS)})"

_TYPE = "lower(trim(name))"
_KNOWN = f"{_TYPE} IN ({', '.join(repr(t) for t in CITATION_TYPES)})"
# Templates the normaliser reads: every known type, and Harvnb.
_READ = f"({_KNOWN} OR name = 'Harvnb')"
_CLASS = f"""CASE {_TYPE} WHEN 'cite encyclopedia' THEN 'encyclopaedia' WHEN 'cite press release' THEN 'pressrelease'
  WHEN 'cite mailing list' THEN 'mailinglist' ELSE list_extract(string_split({_TYPE}, ' '), -1) END"""
# The facts with null instead of values a sfn, infobox or tweet does not carry.
_P = f"""(SELECT *, {_TYPE} AS typ, {_CLASS} AS cls, {_READ} AS known, slot = 31 AS odd,
  CASE WHEN slot <> 31 THEN author_style ELSE -1 END AS style FROM {FACTS} ff)"""


def _only(value: str) -> str:
    return f"CASE WHEN slot <> 31 THEN {value} END"


def cites(spark, sf):
    """Citations with type."""
    return D.citations(spark, sf).withColumn("type_of_citation", C.citation_type("citation"))


def parsed(spark, sf):
    return O.parse_templates(D.citations(spark, sf), "citation")


def with_id_list(spark, sf):
    """Known types with identifiers: what labelling reads."""
    p = O.parse_templates(O.filter_known_types(cites(spark, sf)), "citation")
    return settle(p.withColumn("ID_list", I.extract_ids("params")), ["ID_list"])


def normalized_cites(spark, sf, fields=None):
    return O.normalize_citations(O.filter_known_types(cites(spark, sf)), fields=fields)


LABEL = """CASE WHEN isbn IS NOT NULL AND doi IS NOT NULL AND typ IN ('cite journal', 'cite conference') THEN 'journal'
  WHEN isbn IS NOT NULL AND doi IS NOT NULL AND typ IN ('cite book', 'cite encyclopedia') THEN 'book'
  WHEN pmid IS NOT NULL OR pmc IS NOT NULL THEN 'journal'
  WHEN doi IS NOT NULL AND isbn IS NULL THEN 'journal'
  WHEN isbn IS NOT NULL AND doi IS NULL THEN 'book' ELSE 'other' END"""
LABELLED = f"(SELECT *, {LABEL} AS label FROM {_P} pp WHERE known AND name <> 'Harvnb')"


@query(f"SELECT label, CAST(count(*) AS BIGINT) AS n FROM {LABELLED} l GROUP BY label")
def label_counts(spark, sf):
    return L.label_counts(L.label_book_journal(with_id_list(spark, sf)))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (label = 'book') AS BIGINT) AS books,
             CAST(count(*) FILTER (label = 'journal') AS BIGINT) AS journals,
             CAST(0 AS BIGINT) AS newss FROM {LABELLED} l""")
def label_totals(spark, sf):
    return L.label_totals(L.label_book_journal(with_id_list(spark, sf)))


@query(f"""SELECT typ AS type_of_citation, CAST(count(*) AS BIGINT) AS n FROM {_P} p GROUP BY typ
           ORDER BY n DESC, typ LIMIT 10""")
def citation_types_top(spark, sf):
    counts = cites(spark, sf).groupBy("type_of_citation").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "type_of_citation").limit(10)


@query(f"""SELECT typ AS type_of_citation, CAST(count(*) AS BIGINT) AS n FROM {_P} p
           WHERE NOT ({_KNOWN}) GROUP BY typ""")
def rejected_types(spark, sf):
    return O.rejected_types(cites(spark, sf))


@query(f"""SELECT CASE WHEN slot = 21 THEN ' cite journal' ELSE typ END || CASE WHEN ok % 13 = 0 THEN chr(10) ELSE '' END
             AS type_of_citation, CAST(count(*) AS BIGINT) AS n FROM {_P} p GROUP BY 1""")
def strict_types(spark, sf):
    """Types by the narrow rule: a blank before the name and a line end after it stay."""
    strict = D.citations(spark, sf).withColumn("t", C.citation_type("citation", strict=True))
    return strict.groupBy(F.col("t").alias("type_of_citation")).agg(F.count("*").alias("n"))


@query(f"""SELECT cls AS citation_class, lang_known AS is_template, CAST(count(*) AS BIGINT) AS n FROM
             (SELECT *, known AS lang_known FROM {_P} p) q GROUP BY cls, lang_known""")
def citation_class(spark, sf):
    named = D.citations(spark, sf).withColumn("name", W.template_name("citation"))
    return named.groupBy(
        C.citation_class("name").alias("citation_class"), C.is_citation_template("name").alias("is_template")
    ).agg(F.count("*").alias("n"))


# --- parameters ----------------------------------------------------------------------------------------------


@query(f"SELECT page_id, params_text FROM {FACTS} f")
def template_params(spark, sf):
    rows = D.citations(spark, sf).select("page_id", W.template_params(B.repair_unbalanced("citation")).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("|"), x["name"], F.lit("="), x["value"])), "")
    return rows.select("page_id", text.alias("params_text"))


@query(f"SELECT page_id, title FROM {_P} p WHERE slot <> 31")
def last_param_wins(spark, sf):
    p = parsed(spark, sf)
    return p.where(W.has_param("params", "title", ignore_empty=True)).select(
        "page_id", W.get_param("params", "title", "").alias("title")
    )


@query(f"""SELECT page_id, ok % 17 <> 0 AS balanced, CASE WHEN ok % 17 = 0 THEN citation || '{'}}'}' ELSE citation END AS repaired
           FROM {FACTS} f""")
def balanced(spark, sf):
    return D.citations(spark, sf).select(
        "page_id", B.balanced("citation").alias("balanced"), B.repair_unbalanced("citation").alias("repaired")
    )


_CHANGED = D.duck("SELECT ok AS page_id, '««' || trim(name) || CASE WHEN slot <> 31 AND volume IS NULL THEN "
                  + D.params_text().replace("CASE WHEN slot = 31 THEN '|1='", "CASE WHEN slot = 31 THEN '|'").replace("'|2='", "'|'")
                  + " || '|volume=99' ELSE "
                  + D.params_text(changed={"volume": "'99'"}).replace("'|1='", "'|'").replace("'|2='", "'|'")
                  + " || CASE WHEN slot = 31 THEN '|volume=99' ELSE '' END END || '»»' AS text FROM (")


@query(f"{_CHANGED}{D.duck(D.CITE_FACTS)}) f")
def rewrite_param(spark, sf):
    rows = D.citations(spark, sf).select("page_id", B.repair_unbalanced("citation").alias("text"))
    return R.rewrite_param(rows, "volume", F.lit("99"))


@query(f"""SELECT param, status, CAST(count(*) AS BIGINT) AS n FROM (
             SELECT 'foo' AS param, 'unknown' AS status FROM {_P} p WHERE slot <> 31 AND unknown_value IS NOT NULL
             UNION ALL SELECT 'Publisher', 'suggest' FROM {_P} p WHERE slot <> 31 AND caps_value IS NOT NULL
             UNION ALL SELECT 'coauthors', 'deprecated' FROM {_P} p WHERE slot <> 31 AND coauthors IS NOT NULL
             UNION ALL SELECT '1', 'text' FROM {_P} p WHERE slot = 31 AND name <> 'Harvnb'
             UNION ALL SELECT '2', 'text' FROM {_P} p WHERE slot = 31 AND name <> 'Harvnb') q GROUP BY param, status""")
def unknown_params(spark, sf):
    found = Q.unknown_params(parsed(spark, sf).select("page_id", "params"))
    return found.groupBy("param", "status").agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, 'Periodical' AS field, 'newspaper' AS chosen, 'work' AS ignored FROM {_P} p
           WHERE slot <> 31 AND newspaper IS NOT NULL AND work IS NOT NULL""")
def redundant_params(spark, sf):
    found = Q.redundant_params(parsed(spark, sf).select("page_id", "params"))
    return found.select("page_id", "field", "chosen", F.array_join("ignored", ",").alias("ignored"))


@query(f"""SELECT name, CAST(count(*) AS BIGINT) AS n FROM {_P} p WHERE slot = 31 AND name IN ('sfn', 'Infobox person', 'cite tweet')
           GROUP BY name""")
def rejected_anti(spark, sf):
    """Template names of no language list, by an anti join with the list as a table."""
    names = D.citations(spark, sf).select(F.trim(W.template_name("citation")).alias("name"))
    listed = O.type_names(spark).select(F.lower("name").alias("key")).distinct()
    counted = names.groupBy("name").agg(F.count("*").alias("n"))
    return counted.withColumn("key", F.lower("name")).join(F.broadcast(listed), "key", "left_anti").select("name", "n")


# --- fields --------------------------------------------------------------------------------------------------

_PERIODICAL_RAW = _only("coalesce(journal, newspaper, work, website, encyclopedia)")


@query(f"""SELECT page_id, {_only('title')} AS title, {_PERIODICAL_RAW} AS periodical, {_only('volume')} AS volume,
             {_only('issue')} AS issue, {_only('publisher')} AS publisher, {_only('access_date')} AS access_date,
             CASE WHEN slot = 31 THEN NULL WHEN slot = 20 THEN 'work' WHEN journal IS NOT NULL AND ok % 2 = 0 THEN 'journal'
               WHEN journal IS NOT NULL THEN 'periodical' WHEN newspaper IS NOT NULL THEN 'newspaper'
               WHEN website IS NOT NULL THEN 'website' WHEN encyclopedia IS NOT NULL THEN 'encyclopedia' END AS origin
           FROM {_P} p""")
def alias_fields(spark, sf):
    a = lambda f: C.alias("params", f)
    return parsed(spark, sf).select(
        "page_id", a("Title").alias("title"), a("Periodical").alias("periodical"), a("Volume").alias("volume"),
        a("Issue").alias("issue"), a("PublisherName").alias("publisher"), a("AccessDate").alias("access_date"),
        C.alias_origin("params", "Periodical").alias("origin"),
    )


_AUTHORS = """CASE WHEN style = 0 THEN last1 || ', ' || first1 || '; ' || last2 || ', ' || first2
  WHEN style = 1 THEN last1 || '; ' || last2
  WHEN style = 2 THEN last1 || ', AB; ' || last2 || ', C; Corp ' || CAST(sk AS VARCHAR)
  WHEN style IN (4, 7) THEN last1 || ', ' || first1
  WHEN style = 6 THEN last1 || '; ' || last2 ELSE '' END"""


@query(f"""SELECT page_id, {_AUTHORS} AS authors, CASE WHEN style = 4 THEN 'Page ' || CAST(sk AS VARCHAR) END AS link,
             CASE WHEN style = 7 THEN last2 || ', ' || first2 ELSE '' END AS editors FROM {_P} p""")
def authors(spark, sf):
    p = parsed(spark, sf).select(
        "page_id", N.authors("params").alias("a"), N.authors("params", "editor").alias("e")
    )
    return p.select(
        "page_id",
        N.people_text("a").alias("authors"),
        F.try_element_at("a", F.lit(1))["link"].alias("link"),
        N.people_text("e").alias("editors"),
    )


@query(f"""SELECT page_id, CASE WHEN style = 2 THEN last1 || ' AB|' || last2 || ' C|Corp ' || CAST(sk AS VARCHAR) || ' ' END AS names
           FROM {_P} p WHERE style = 2""")
def vauthors(spark, sf):
    p = parsed(spark, sf).where(W.has_param("params", "vauthors"))
    names = N.vancouver_names(W.get_param("params", "vauthors"))
    return p.select(
        "page_id",
        F.array_join(F.transform(names, lambda x: F.concat_ws(" ", x["last"], x["first"])), "|").alias("names"),
    )


@query(f"""SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN style IN (0, 1, 4, 6, 7) THEN 'numbered' WHEN style = 2 THEN 'vancouver' WHEN style = 3 THEN 'text'
             ELSE 'none' END AS source FROM {_P} p) q GROUP BY source""")
def author_source(spark, sf):
    return (
        parsed(spark, sf).groupBy(N.author_source("params").alias("source")).agg(F.count("*").alias("n"))
    )


@query(f"SELECT page_id, last2 AS stripped, TRUE AS flag FROM {_P} p WHERE style = 1")
def et_al(spark, sf):
    p = parsed(spark, sf).select("page_id", F.try_element_at("params", F.lit("author2")).alias("a"))
    return p.where(F.col("a").isNotNull()).select(
        "page_id", N.strip_et_al("a").alias("stripped"), N.has_et_al("a").alias("flag")
    )


@query(f"""SELECT page_id, replace(pages, '–', '-') AS cleaned, replace(pages, '-', '–') AS dashed
           FROM {_P} p WHERE pages IS NOT NULL""")
def clean_pages(spark, sf):
    p = parsed(spark, sf).select("page_id", C.alias("params", "Pages").alias("v")).where(F.col("v").isNotNull())
    return p.select("page_id", FD.clean_pages("v").alias("cleaned"), FD.hyphen_to_dash("v").alias("dashed"))


@query(f"""SELECT page_id, CASE sk % 3 WHEN 0 THEN 'Journal of J' || CAST(sk % 20 AS VARCHAR)
             WHEN 1 THEN 'Annals N' || CAST(sk % 20 AS VARCHAR) ELSE 'Review 7' END AS periodical
           FROM {_P} p WHERE journal IS NOT NULL""")
def unlink(spark, sf):
    p = parsed(spark, sf)
    journal = F.coalesce(*[F.try_element_at("params", F.lit(n)) for n in ("journal", "periodical")],
                         F.when(F.lower("template_name") == "cite journal", F.try_element_at("params", F.lit("work"))))
    return p.select("page_id", W.unlink(journal).alias("periodical")).where(F.col("periodical").isNotNull())


_VOLUME = "CASE WHEN cls IN ('book', 'journal') THEN volume END"
_ISSUE = "CASE WHEN cls IN ('journal', 'news') THEN issue END"


@query(f"""SELECT page_id, CASE WHEN slot <> 31 THEN {_VOLUME} END AS volume, CASE WHEN slot <> 31 THEN {_ISSUE} END AS issue,
             CAST(NULL AS VARCHAR) AS access_date, CAST(NULL AS VARCHAR) AS series_number, {_only('coalesce(page, pages)')} AS pages
           FROM {_P} p""")
def class_fields(spark, sf):
    a = lambda f: C.alias("params", f)
    return parsed(spark, sf).select(
        "page_id",
        C.volume_rule("cls", a("Volume"), a("Periodical")).alias("volume"),
        C.issue_rule("cls", a("Issue"), a("Periodical")).alias("issue"),
        C.access_date_rule("cls", a("AccessDate")).alias("access_date"),
        C.series_number_rule("cls", a("SeriesNumber")).alias("series_number"),
        C.choose_pages(a("Sheet"), a("Sheets"), C.page_rule("cls", a("Page")), C.page_rule("cls", a("Pages")), a("At")).alias("pages"),
    )


_TITLE = "CASE WHEN title_style = 2 THEN plain_title || ' ' ELSE plain_title END"


@query(f"""SELECT page_id, encyclopedia AS "Title", {_TITLE} AS "Chapter", '' AS "Periodical"
           FROM {_P} p WHERE slot = 23""")
def encyclopedia_remap(spark, sf):
    n = normalized_cites(spark, sf, ["Title", "Chapter", "Periodical"]).where(F.col("cls") == "encyclopaedia")
    return n.select("page_id", "Title", "Chapter", "Periodical")


@query(f"""SELECT page_id, coalesce(book_title, {_TITLE}) AS "Title", CASE WHEN book_title IS NOT NULL THEN {_TITLE} ELSE '' END AS "Chapter"
           FROM {_P} p WHERE slot = 22""")
def conference_remap(spark, sf):
    n = normalized_cites(spark, sf, ["Title", "Chapter"]).where(F.col("cls") == "conference")
    return n.select("page_id", "Title", "Chapter")


_URL = "CASE WHEN slot = 31 OR slot = 26 THEN '' ELSE coalesce(url, CASE WHEN cls = 'journal' AND pmc IS NOT NULL THEN '//www.ncbi.nlm.nih.gov/pmc/articles/PMC' || pmc END, '') END"


@query(f"""SELECT page_id, {_URL} AS "URL" FROM {_P} p WHERE known AND name <> 'Harvnb'""")
def url_rule(spark, sf):
    return normalized_cites(spark, sf, ["URL"]).select("page_id", "URL")


_M2, _D2 = "lpad(CAST(m AS VARCHAR), 2, '0')", "lpad(CAST(d AS VARCHAR), 2, '0')"
_Y, _Y1 = "CAST(y AS VARCHAR)", "CAST(y + 1 AS VARCHAR)"
_ISO = f"""CASE date_style WHEN 0 THEN {_Y} || '-' || {_M2} || '-' || {_D2} WHEN 1 THEN {_Y} || '-' || {_M2} || '-' || {_D2}
  WHEN 2 THEN {_Y} || '-' || {_M2} || '-' || {_D2} WHEN 3 THEN {_Y} || '-' || {_M2} WHEN 4 THEN {_Y} WHEN 5 THEN {_Y}
  WHEN 9 THEN {_Y} || '/' || {_Y1}
  WHEN 10 THEN CASE WHEN 4 + d <= CASE WHEN m = 2 THEN 28 + CASE WHEN y % 4 = 0 THEN 1 ELSE 0 END
                                     WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END
    THEN {_Y} || '-' || {_M2} || '-03/' || {_Y} || '-' || {_M2} || '-' || lpad(CAST(4 + d AS VARCHAR), 2, '0') END
  WHEN 12 THEN CASE WHEN y % 100 <> 99 THEN {_Y} || '/' || {_Y1} END WHEN 13 THEN year END"""
_DATE_TEXT = "coalesce(date, year)"
_PUB = "regexp_replace(coalesce(publisher, ''), '[][]', '', 'g')"
_PERIODICAL = f"""CASE WHEN slot = 23 THEN '' WHEN slot = 26 THEN 'arXiv' WHEN journal IS NOT NULL THEN CASE sk % 3 WHEN 0 THEN 'Journal of J' || CAST(sk % 20 AS VARCHAR)
             WHEN 1 THEN 'Annals N' || CAST(sk % 20 AS VARCHAR) ELSE 'Review 7' END ELSE coalesce(newspaper, website, '') END"""
_NORMAL = f"""SELECT page_id, typ AS type_of_citation,
  CASE WHEN slot = 23 THEN encyclopedia WHEN slot = 22 AND book_title IS NOT NULL THEN book_title
       WHEN slot = 29 THEN '' ELSE {_TITLE} END AS "Title",
  CASE WHEN slot = 23 OR slot = 29 OR slot = 22 AND book_title IS NOT NULL THEN {_TITLE} ELSE '' END AS "Chapter",
  {_URL} AS "URL", {_PERIODICAL} AS "Periodical", coalesce(encyclopedia, '') AS "Encyclopedia",
  {_PUB} AS "PublisherName", coalesce({_VOLUME}, '') AS "Volume", coalesce({_ISSUE}, '') AS "Issue",
  replace(coalesce(page, pages, ''), '–', '-') AS "Pages", coalesce({_ISO}, '') AS "Date",
  CASE WHEN {_ISO} IS NULL THEN coalesce({_DATE_TEXT}, '') ELSE '' END AS "Chron",
  CASE slot WHEN 27 THEN ' (Thesis)' WHEN 28 THEN ' (Map)' WHEN 30 THEN CASE cls WHEN 'techreport' THEN ' (Technical report)'
    WHEN 'pressrelease' THEN ' (Press release)' WHEN 'mailinglist' THEN ' (Mailing list)' ELSE '' END ELSE '' END AS "TitleType",
  {_AUTHORS} AS "Authors",
  '' AS "AccessDate", '' AS "SeriesNumber", '' AS "City", '' AS "Degree", '' AS "Format", '' AS "Series", '' AS "Edition",
  '' AS "PublicationPlace"
  FROM {_P} p WHERE known AND name <> 'Harvnb'"""


@query(_NORMAL)
def normalized(spark, sf):
    """The whole schema, without the identifiers (see id_pivot)."""
    n = O.legacy_text(normalized_cites(spark, sf))
    return n.select("page_id", "type_of_citation", *[f for f in O.FIELDS if f != "ID_list"])


_SET = ["Title", "Chapter", "PublisherName", "Periodical", "Volume", "Issue"]


_N_SET = " + ".join(f"CASE WHEN \"{c}\" <> '' THEN 1 ELSE 0 END" for c in _SET)


@query(f"SELECT page_id, CAST({_N_SET} AS BIGINT) AS n_set FROM ({_NORMAL}) n")
def compact_fields(spark, sf):
    n = O.compact_fields(normalized_cites(spark, sf, _SET), _SET)
    return n.select("page_id", F.size("fields").cast("bigint").alias("n_set"))


# --- identifiers ---------------------------------------------------------------------------------------------

_IDS = {
    "DOI": "doi", "ISBN": "isbn", "ISSN": "issn", "PMID": "pmid", "PMC": "pmc", "ARXIV": "arxiv", "LCCN": "lccn",
    "OL": "ol",
}
_ID_ROWS = " UNION ALL ".join(
    f"SELECT page_id, flaw, pk, sk, ok, m, '{k}' AS kind, {c} AS value FROM {_P} p WHERE slot <> 31 AND {_KNOWN} AND {c} IS NOT NULL"
    for k, c in _IDS.items()
)


def id_rows(spark, sf):
    return with_id_list(spark, sf).select("page_id", F.explode("ID_list").alias("kind", "value"))


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM ({_ID_ROWS}) i GROUP BY kind")
def id_kinds(spark, sf):
    return L.id_kinds(with_id_list(spark, sf))


@query(f"""SELECT page_id, {', '.join(f'{c} AS "{k}"' for k, c in _IDS.items())}, CAST(NULL AS VARCHAR) AS "OCLC"
           FROM {_P} p WHERE {_KNOWN}""")
def id_pivot(spark, sf):
    return L.id_columns(with_id_list(spark, sf)).select("page_id", *_IDS, "OCLC")


_ALL_KINDS = ", ".join(f'{_IDS[k]} AS "{k}"' if k in _IDS else f'CAST(NULL AS VARCHAR) AS "{k}"' for k in L.KINDS)


@query(f"SELECT page_id, citation, {_ALL_KINDS} FROM {_P} p WHERE {_KNOWN}")
def id_pivot_whole(spark, sf):
    """A column for each kind of identifier."""
    return L.id_columns(with_id_list(spark, sf)).select("page_id", "citation", *L.KINDS)


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len) AS BIGINT) AS n_ids FROM (SELECT DISTINCT page_id, citation,
             {' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in _IDS.values())} AS len FROM {_P} p WHERE {_KNOWN}) q WHERE len > 0""")
def rows_with_ids(spark, sf):
    rows = L.with_ids(with_id_list(spark, sf).select("page_id", "citation", "ID_list"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.size("ID_list")).alias("n_ids"))


_FIRST_SUM = " + ".join(f"CAST(substring(z, {i}, 1) AS BIGINT) * {1 if i % 2 else 3}" for i in range(1, 14))


@query(f"""SELECT value, CAST(n AS BIGINT) AS n, ({_FIRST_SUM}) % 10 = 0 AS valid, replace(value, '-', '') AS bare FROM (
             SELECT value, count(*) AS n, replace(value, '-', '') AS z FROM ({_ID_ROWS}) i WHERE kind = 'ISBN' GROUP BY value) q""")
def isbn_valid(spark, sf):
    rows = id_rows(spark, sf).where("kind = 'ISBN'").groupBy("value").agg(F.count("*").alias("n"))
    return rows.select(
        "value", "n", I.valid_isbn("value").alias("valid"), F.translate(I.clean_isbn("value"), "-", "").alias("bare")
    )


@query(f"""SELECT page_id, value, flaw <> 0 AS valid, value AS shown FROM ({_ID_ROWS}) i WHERE kind = 'ISSN'""")
def issn_valid(spark, sf):
    rows = id_rows(spark, sf).where("kind = 'ISSN'")
    return rows.select("page_id", "value", I.valid_issn("value").alias("valid"), I.format_issn("value").alias("shown"))


@query(f"SELECT page_id, value, flaw <> 0 AS valid FROM ({_ID_ROWS}) i WHERE kind = 'DOI'")
def doi_valid(spark, sf):
    return id_rows(spark, sf).where("kind = 'DOI'").select("page_id", "value", I.valid_doi("value").alias("valid"))


@query(f"""SELECT kind, value, CASE WHEN kind = 'PMID' THEN flaw > 1 ELSE flaw <> 0 END AS valid FROM ({_ID_ROWS}) i
           WHERE kind IN ('PMID', 'PMC')""")
def pmid_pmc_valid(spark, sf):
    rows = id_rows(spark, sf).where("kind IN ('PMID', 'PMC')")
    valid = F.when(F.col("kind") == "PMID", I.valid_pmid("value")).otherwise(I.valid_pmc("value"))
    return rows.select("kind", "value", valid.alias("valid"))


@query(f"""SELECT value, CASE flaw WHEN 0 THEN FALSE WHEN 1 THEN CASE WHEN 90 + pk % 10 = 90 THEN FALSE WHEN 90 + pk % 10 = 91 THEN m >= 7
             ELSE TRUE END ELSE TRUE END AS valid FROM ({_ID_ROWS}) i WHERE kind = 'ARXIV'""")
def arxiv_valid(spark, sf):
    return id_rows(spark, sf).where("kind = 'ARXIV'").select("value", I.valid_arxiv("value").alias("valid"))


@query(f"""SELECT value, CASE flaw WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN TRUE WHEN 0 THEN length(value) = 11 ELSE FALSE END AS valid,
             CASE flaw WHEN 2 THEN 'n78' || lpad(CAST(pk AS VARCHAR), 6, '0') WHEN 3 THEN lpad(CAST(pk AS VARCHAR), 8, '0')
               WHEN 4 THEN 'n' || lpad(CAST(pk AS VARCHAR), 8, '0') ELSE value END AS normal
           FROM ({_ID_ROWS}) i WHERE kind = 'LCCN'""")
def lccn_valid(spark, sf):
    rows = id_rows(spark, sf).where("kind = 'LCCN'")
    return rows.select("value", I.valid_lccn("value").alias("valid"), I.normalize_lccn("value").alias("normal"))


@query(f"""SELECT value, flaw <> 0 AS valid, CASE flaw WHEN 0 THEN 'OL' WHEN 1 THEN 'authors/OL' WHEN 2 THEN 'books/OL'
             ELSE 'works/OL' END AS path FROM ({_ID_ROWS}) i WHERE kind = 'OL'""")
def ol_valid(spark, sf):
    rows = id_rows(spark, sf).where("kind = 'OL'")
    return rows.select("value", I.valid_ol("value").alias("valid"), I.ol_path("value").alias("path"))


# Codes of shops, music scores and messages made from suppliers and parts.
@query("""SELECT p_partkey, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS code,
            TRUE AS valid_asin, CASE p_partkey % 3 WHEN 0 THEN 'co.jp' WHEN 1 THEN 'com.br' ELSE 'de' END AS shop,
            p_partkey % 4 <> 0 AS valid_message, p_partkey % 10 = (10 - (9 + 21 + 9 + (CAST(floor(p_partkey / 10) AS BIGINT) % 10) * 3) % 10) % 10 AS valid_ismn
          FROM part""")
def shop_codes(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    key = F.col("p_partkey")
    code = F.concat(F.lit("B"), F.lpad(key.cast("string"), 9, "0"))
    tld = F.element_at(F.array(F.lit("jp"), F.lit("br"), F.lit("de")), (key % 3 + 1).cast("int"))
    message = F.when(key % 4 == 0, F.concat(F.lit("<"), key.cast("string"), F.lit("@x>"))).otherwise(
        F.concat(key.cast("string"), F.lit("@x"))
    )
    ismn = F.concat(F.lit("9790-0000-000-"), F.lpad((key % 100).cast("string"), 2, "0"))
    return part.select(
        "p_partkey", code.alias("code"), I.valid_asin(code).alias("valid_asin"), I.asin_domain(tld).alias("shop"),
        I.valid_message_id(message).alias("valid_message"), I.valid_ismn(ismn).alias("valid_ismn"),
    )


_URLS_OF = " ".join(
    f"WHEN '{k}' THEN '{p}' || value" for k, (_, p) in ID_KINDS.items() if k not in ("ASIN", "OL", "ISMN")
)


@query(f"""SELECT page_id, kind, CASE kind {_URLS_OF}
             WHEN 'OL' THEN '//openlibrary.org/' || CASE flaw WHEN 0 THEN 'OL' WHEN 1 THEN 'authors/OL' WHEN 2 THEN 'books/OL'
             ELSE 'works/OL' END || value END AS url FROM ({_ID_ROWS}) i""")
def id_urls(spark, sf):
    return id_rows(spark, sf).select("page_id", "kind", I.id_url("kind", "value").alias("url"))


@query(f"""SELECT page_id, {', '.join(f'coalesce({c}, {chr(39) * 2}) AS {c}' for c in ('doi', 'isbn', 'pmid'))} FROM {_P} p
           WHERE {_KNOWN} AND ({' OR '.join(f'{c} IS NOT NULL' for c in _IDS.values())})""")
def id_text_round_trip(spark, sf):
    """Identifiers written as text and read back: commas, colons and equal signs in a value survive."""
    n = O.legacy_text(with_id_list(spark, sf).withColumn("Authors", N.authors("params")))
    back = L.parse_id_text(n.where(F.col("ID_list") != ""))
    value = lambda k: F.coalesce(F.try_element_at("ID_list", F.lit(k)), F.lit(""))
    return back.select("page_id", value("DOI").alias("doi"), value("ISBN").alias("isbn"), value("PMID").alias("pmid"))


# --- dates ---------------------------------------------------------------------------------------------------

_DATED = f"(SELECT * FROM {_P} p WHERE slot <> 31 AND date IS NOT NULL)"
_DATE_OK = f"CASE WHEN date_style = 8 OR date_style = 11 THEN FALSE WHEN date_style IN (10, 12) THEN {_ISO} IS NOT NULL ELSE TRUE END"


def dated(spark, sf):
    return parsed(spark, sf).select("page_id", "params", C.alias("params", "Date").alias("date")).where(
        F.col("date").isNotNull()
    )


@query(f"""SELECT page_id, date, CASE WHEN date_style IN (6, 7) THEN NULL ELSE {_ISO} END AS iso,
             CASE date_style WHEN 5 THEN CASE m % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'fall' END
               WHEN 12 THEN CASE WHEN y % 100 <> 99 THEN 'winter' END END AS season,
             CASE WHEN {_ISO} IS NULL THEN date ELSE '' END AS chron FROM {_DATED} x""")
def dates_iso(spark, sf):
    return dated(spark, sf).select(
        "page_id", "date", DT.iso_date("date", 2026).alias("iso"), DT.season("date", 2026).alias("season"),
        DT.chron("date", 2026).alias("chron"),
    )


@query(f"""SELECT page_id, date, {_DATE_OK} AS valid,
             CASE date_style WHEN 6 THEN 'approx' WHEN 7 THEN 'none' END AS marker FROM {_DATED} x""")
def date_valid(spark, sf):
    return dated(spark, sf).select(
        "page_id", "date", DT.acceptable_date("date", 2026).alias("valid"), DT.approx_or_no_date("date").alias("marker")
    )


@query("""SELECT o_orderkey, CAST(d AS BIGINT) AS day, CASE WHEN d <= CASE WHEN m = 2 THEN
              CASE WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 29 ELSE 28 END
              WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END THEN TRUE ELSE FALSE END AS valid, lpad(CAST(m AS VARCHAR), 2, '0') AS month,
            m < 10 AS range_ok
          FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, 28 + o_orderkey % 4 AS d FROM orders) q""")
def calendar_days(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    day = 28 + F.col("o_orderkey") % 4
    name, later = F.date_format("o_orderdate", "MMMM"), F.date_format(F.add_months("o_orderdate", 3), "MMMM")
    return orders.select(
        "o_orderkey", day.cast("bigint").alias("day"),
        DT.valid_date(F.year("o_orderdate"), DT.month_number(name), day, 2026).alias("valid"),
        F.lpad(DT.month_number(name).cast("string"), 2, "0").alias("month"),
        DT.valid_month_range(name, later).alias("range_ok"),
    )


@query(f"""SELECT page_id, date, year, CAST(CASE WHEN sk % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS code
           FROM {_DATED} x WHERE year IS NOT NULL""")
def year_mismatch(spark, sf):
    p = dated(spark, sf).withColumn("year", C.alias("params", "Year")).where(F.col("year").isNotNull())
    return p.select("page_id", "date", "year", DT.year_date_mismatch("year", "date").cast("bigint").alias("code"))


@query(f"""SELECT page_id, access_date, CAST(access_date AS DATE) >= DATE '2001-01-15'
             AND CAST(access_date AS DATE) < DATE '2026-01-03' AS valid,
             CAST(access_date AS DATE) >= DATE '2026-01-01' AS closed FROM {_P} p WHERE slot <> 31 AND access_date IS NOT NULL""")
def access_date(spark, sf):
    p = parsed(spark, sf).select("page_id", C.alias("params", "AccessDate").alias("access_date"))
    day, now = DT.parse_date("access_date", 2100)["start"], F.lit("2026-01-01").cast("date")
    return p.where(F.col("access_date").isNotNull()).select(
        "page_id", "access_date", DT.valid_access_date(day, now).alias("valid"), DT.embargoed(day, now).alias("closed")
    )


# --- addresses -----------------------------------------------------------------------------------------------


@query(f"SELECT page_id, url, domain AS tld FROM {_P} p WHERE slot <> 31 AND url IS NOT NULL")
def top_domain(spark, sf):
    p = parsed(spark, sf).select("page_id", C.alias("params", "URL").alias("url")).where(F.col("url").isNotNull())
    return L.with_domain(p, "url")


@query(f"""SELECT page_id, url, pk % 6 <> 4 AS valid, pk % 6 = 3 AS pdf, pk % 6 = 2 AS google_book,
             CASE WHEN pk % 6 = 3 THEN 'PDF' END AS format FROM {_P} p WHERE slot <> 31 AND url IS NOT NULL""")
def url_checks(spark, sf):
    p = parsed(spark, sf).select("page_id", C.alias("params", "URL").alias("url")).where(F.col("url").isNotNull())
    return p.select(
        "page_id", "url", U.valid_url("url").alias("valid"), U.is_pdf("url").alias("pdf"),
        U.is_google_book("url").alias("google_book"), U.default_format(F.lit(None).cast("string"), "url").alias("format"),
    )


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+:)', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS domain,
            TRUE AS valid, TRUE AS linked, FALSE AS page_name FROM pages""")
def page_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    u = U.split_url("url")
    return pages.select(
        "page_id", u["scheme"].alias("scheme"), u["domain"].alias("domain"), U.valid_url("url").alias("valid"),
        U.has_external_link(F.concat(F.lit("see "), F.col("url"))).alias("linked"), U.link_param_ok("url").alias("page_name"),
    )


# --- quality -------------------------------------------------------------------------------------------------

_LCCN_OK = "CASE flaw WHEN 0 THEN length(lccn) = 11 WHEN 4 THEN FALSE ELSE TRUE END"
_ARXIV_OK = """CASE flaw WHEN 0 THEN FALSE WHEN 1 THEN CASE pk % 10 WHEN 0 THEN FALSE WHEN 1 THEN m >= 7 ELSE TRUE END
  ELSE TRUE END"""
_ERRORS = f"""
  SELECT 'bad_doi' AS kind, doi IS NOT NULL AND flaw = 0 AS hit FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_isbn', isbn IS NOT NULL AND flaw = 0 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_issn', issn IS NOT NULL AND flaw = 0 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_pmid', pmid IS NOT NULL AND flaw <= 1 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_pmc', pmc IS NOT NULL AND flaw = 0 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_ol', ol IS NOT NULL AND flaw = 0 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_url', url IS NOT NULL AND pk % 6 = 4 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_date', date IS NOT NULL AND NOT ({_DATE_OK}) FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'deprecated_params', coauthors IS NOT NULL FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'coauthors_missing_author', coauthors IS NOT NULL AND style = 5 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'parameter_ignored', unknown_value IS NOT NULL FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'parameter_ignored_suggest', caps_value IS NOT NULL FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'redundant_parameters', newspaper IS NOT NULL AND work IS NOT NULL FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'text_ignored', name <> 'Harvnb' FROM {_P} p WHERE slot = 31
  UNION ALL SELECT 'maint_etal', style = 1 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'maint_extra_text', page LIKE 'p. %' FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'date_mismatch', date IS NOT NULL AND year IS NOT NULL AND sk % 2 = 1 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'maint_date_year', date IS NOT NULL AND year IS NOT NULL AND sk % 2 = 0 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'accessdate_missing_url', access_date IS NOT NULL AND url IS NULL FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'arxiv_params_not_supported', slot = 26 AND coalesce(doi, isbn, issn, pmid, pmc, lccn, ol) IS NOT NULL FROM {_P} p
  UNION ALL SELECT 'citation_missing_title', slot IN (29, 31) FROM {_P} p
"""
_ALL_ERRORS = f"""{_ERRORS}
  UNION ALL SELECT 'first_missing_last', style = 6 FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_arxiv', arxiv IS NOT NULL AND NOT ({_ARXIV_OK}) FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'bad_lccn', lccn IS NOT NULL AND NOT ({_LCCN_OK}) FROM {_P} p WHERE slot <> 31
  UNION ALL SELECT 'cite_web_url', cls IN ('web', 'podcast', 'mailinglist') AND url IS NULL FROM {_P} p WHERE slot <> 31
"""


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM ({_ERRORS}) e WHERE hit GROUP BY kind")
def error_counts(spark, sf):
    kinds = [
        "bad_doi", "bad_isbn", "bad_issn", "bad_pmid", "bad_pmc", "bad_ol", "bad_url", "bad_date", "deprecated_params",
        "coauthors_missing_author", "parameter_ignored", "parameter_ignored_suggest", "redundant_parameters",
        "text_ignored", "maint_etal", "maint_extra_text", "date_mismatch", "maint_date_year", "accessdate_missing_url",
        "arxiv_params_not_supported", "citation_missing_title",
    ]
    return Q.quality_report(parsed(spark, sf)).where(F.col("kind").isin(*kinds))


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM ({_ALL_ERRORS}) e WHERE hit GROUP BY kind")
def quality_report(spark, sf):
    return Q.quality_report(parsed(spark, sf))


@query("""SELECT doc_id, 'line feed' AS "group", CAST(instr(text, chr(10)) AS BIGINT) AS position FROM documents
          WHERE contains(text, chr(10))""")
def invisible_chars(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.create_map(F.lit("text"), F.col("text")).alias("params")
    )
    found = Q.invisible_report(docs).where(F.col("group") == "line feed")
    return found.select("doc_id", "group", F.col("position").cast("bigint").alias("position"))


@query()
def invisible_chars_whole(spark, sf):
    """Every group of characters that is in a text, with its first position."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.create_map(F.lit("text"), F.col("text")).alias("params")
    )
    return Q.invisible_report(docs).select("doc_id", "group", F.col("position").cast("bigint").alias("position"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'Y' WHEN 2 THEN 'usurped' ELSE 'maybe' END AS value,
            o_orderkey % 4 <= 1 AS flag_ok, o_orderkey % 4 <= 2 AS dead_ok FROM orders""")
def keyword_values(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    value = F.element_at(
        F.array(*[F.lit(v) for v in ("yes", "Y", "usurped", "maybe")]), (F.col("o_orderkey") % 4 + 1).cast("int")
    )
    return orders.select(
        "o_orderkey", value.alias("value"), FD.valid_keyword(value, "registration").alias("flag_ok"),
        FD.valid_keyword(value, "dead-url").alias("dead_ok"),
    )
