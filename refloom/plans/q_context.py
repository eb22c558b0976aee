"""Queries on domains, context, joins, record look-up, features, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import citation as C
from refloom.functions import similarity as S
from refloom.functions.braces import repair_unbalanced
from refloom.functions.urls import top_domain
from refloom.operators import citations as O
from refloom.operators import context as X
from refloom.operators import features as M
from refloom.operators import labels as L
from refloom.operators import lookup as K
from refloom.operators import matching as MT
from refloom.operators import models as ML
from refloom.plans import derived as D
from refloom.plans.q_citations import _P, LABELLED, cites, normalized_cites, with_id_list
from refloom.plans.q_wikitext import TEMPLATES
from refloom.plans.registry import query
from refloom.session import materialize, scratch_path
from refloom.sources.dump import bucketed_stage
from refloom.sources.lists import bias_address, domains_text
from refloom.streaming import parts as ST
from refloom.tables.templates import CITATION_TYPES

_LIST = D.duck(D.NEWS_LIST)
# Names of the listed sites: the line without a dot gives none.
_SITES = f"SELECT DISTINCT 'site' || regexp_extract(value, 'site([0-9]+)', 1) AS domain FROM ({_LIST}) x WHERE contains(value, '.')"


def news_domains(spark, sf):
    lines = D.news_list(spark, sf).select(bias_address().alias("address")).where(F.contains("address", F.lit(".")))
    return L.build_domain_set(lines)


def labelled_cites(spark, sf):
    """Known types with identifiers, label and address."""
    p = L.label_book_journal(with_id_list(spark, sf))
    return p.withColumn("URL", F.coalesce(C.alias("params", "URL"), F.lit(""))).select(
        "page_id", "page_title", "citation", "type_of_citation", "ID_list", "actual_label", "URL"
    )


# --- domains -------------------------------------------------------------------------------------------------


@query(f"""{_SITES} UNION SELECT DISTINCT list_extract(string_split(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '.'), -2) FROM pages""")
def domain_set(spark, sf):
    """Names of the list and of the crawled pages together."""
    lines = D.news_list(spark, sf).select(bias_address().alias("address")).where(F.contains("address", F.lit(".")))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url")
    return L.build_domain_set(lines, pages)


@query(f"SELECT string_agg(domain, ',' ORDER BY domain) AS domains FROM ({_SITES}) s")
def domains_as_text(spark, sf):
    return domains_text(news_domains(spark, sf))


_NEWS = f"(SELECT l.*, CASE WHEN slot <> 31 THEN domain ELSE '' END AS tld, label AS rule, CASE WHEN label = 'other' AND domain IN ({_SITES}) THEN 'news' ELSE label END AS final FROM {LABELLED} l)"


@query(f"SELECT page_id, tld, final AS actual_label FROM {_NEWS} n")
def label_news(spark, sf):
    done = L.label_news(labelled_cites(spark, sf), news_domains(spark, sf))
    return done.select("page_id", "tld", "actual_label")


# A suffix list as it is published: rules of one to three labels, a wildcard with an exception, comments and blank lines.
_SUFFIXES = ["// list", "", "com", "co.th", "com.my", "com.pk  // note", "x.gov.pk", "*.ck", "!open.ck", "org"]
_HOSTS = ["www.{}.com", "{}.co.th", "www.{}.com.my", "news.{}.com.pk", "a.{}.x.gov.pk", "{}.any.ck", "{}.open.ck", "{}.org:80", "10.0.0.1"]
_HOST_SQL = "CASE k % 9 " + " ".join(
    f"WHEN {i} THEN 'https://{h.replace('{}', chr(39) + ' || name || ' + chr(39))}/x'" for i, h in enumerate(_HOSTS)
) + " END"
# `open.ck` is itself a registered name, not a suffix.
_TLD_SQL = "CASE k % 9 WHEN 6 THEN 'open' WHEN 8 THEN '10.0.0.1' ELSE name END"
_SITE_ROWS = """SELECT c_custkey AS k, 'site' || CAST(c_custkey % 50 AS VARCHAR) AS name,
  CASE WHEN c_custkey % 7 = 0 THEN 'book' ELSE 'other' END AS label FROM customer"""
_LISTED = "SELECT 'site' || CAST(n_nationkey AS VARCHAR) AS name, n_nationkey AS k FROM nation"


def _hosts(rows):
    address = F.lit(None).cast("string")
    for i, h in enumerate(_HOSTS):
        before, _, after = h.partition("{}")
        full = F.concat(F.lit("https://" + before), F.col("name"), F.lit(after + "/x")) if after else F.lit(f"https://{h}/x")
        address = F.when(F.col("k") % len(_HOSTS) == i, full).otherwise(address)
    return rows.withColumn("URL", address)


def suffix_list(spark):
    return spark.createDataFrame([(x,) for x in _SUFFIXES], "line string")


@query(f"""SELECT k AS page_id, {_TLD_SQL} AS tld,
             CASE WHEN label = 'other' AND {_TLD_SQL} IN (SELECT {_TLD_SQL} FROM ({_LISTED}) l) THEN 'news' ELSE label END AS actual_label
           FROM ({_SITE_ROWS}) r""")
def label_news_by_suffix_table(spark, sf):
    """Labels by domain where a public suffix list of several levels tells names from suffixes, in rows and domain set alike."""
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    listed = _hosts(nations.select(F.concat(F.lit("site"), "n_nationkey").alias("name"), F.col("n_nationkey").alias("k")))
    suffixes = suffix_list(spark)
    domains = L.build_domain_set(listed.select("URL"), suffixes=suffixes)
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("page_id"), F.col("c_custkey").alias("k"), F.concat(F.lit("site"), (F.col("c_custkey") % 50).cast("string")).alias("name"),
        F.when(F.col("c_custkey") % 7 == 0, "book").otherwise("other").alias("actual_label"),
    )
    return L.label_news(_hosts(rows), domains, suffixes=suffixes).select("page_id", "tld", "actual_label")


@query(f"""SELECT tld AS domain, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (final = 'news') AS BIGINT) AS n_news
           FROM {_NEWS} n GROUP BY ROLLUP (tld)""")
def news_share_by_domain(spark, sf):
    return L.news_share(L.label_news(labelled_cites(spark, sf), news_domains(spark, sf)))


@query(f"""SELECT 'part' || CAST(page_id % 4 AS VARCHAR) AS part, typ AS type, final AS label, CAST(count(*) AS BIGINT) AS n,
             CAST(GROUPING(page_id % 4, typ, final) AS BIGINT) AS level FROM {_NEWS} n
           GROUP BY CUBE (page_id % 4, typ, final)""")
def labels_cube(spark, sf):
    done = L.label_news(labelled_cites(spark, sf), news_domains(spark, sf))
    parted = done.withColumn("part_no", F.concat(F.lit("part"), (F.col("page_id") % 4).cast("string")))
    return L.labels_cube(parted, "part_no").withColumn("level", F.col("level").cast("bigint"))


@query(f"""SELECT label, CAST(count(*) AS BIGINT) AS n FROM {LABELLED} l WHERE url LIKE 'https://books.google.com/books?id=%'
           GROUP BY label""")
def google_books(spark, sf):
    return L.google_book_counts(labelled_cites(spark, sf))


_WEB = "SELECT citation FROM (SELECT citation, ok, slot, pk FROM {p} q WHERE slot BETWEEN 16 AND 19 AND pk % 6 = 0) w".format(p=_P)


@query(f"""SELECT page_id, CASE WHEN citation IN ({_WEB}) THEN 'web' WHEN pmc IS NOT NULL OR pmid IS NOT NULL THEN 'journal'
             WHEN doi IS NOT NULL THEN 'journal' WHEN isbn IS NOT NULL THEN 'book' ELSE 'NO LABEL' END AS needs_a_label
           FROM {LABELLED} l""")
def label_at_prediction(spark, sf):
    rows = labelled_cites(spark, sf).withColumnRenamed("citation", "citations")
    # The news table here: newspaper citations on British sites.
    news = rows.where((F.col("type_of_citation") == "cite news") & F.contains("URL", F.lit(".co.uk/")))
    return L.label_at_prediction(rows, news).select("page_id", "needs_a_label")


@query(f"""SELECT CASE WHEN label = 'other' THEN 'unlabelled' ELSE 'labelled' END AS side, CAST(count(*) AS BIGINT) AS n
           FROM {LABELLED} l GROUP BY 1""")
def split_labelled(spark, sf):
    yes, no = L.split_labelled(labelled_cites(spark, sf))
    side = lambda df, name: df.groupBy(F.lit(name).alias("side")).agg(F.count("*").alias("n"))
    return side(yes, "labelled").unionByName(side(no, "unlabelled"))


# --- context -------------------------------------------------------------------------------------------------

_TOKEN = X._TOKEN.replace("'", "''")
_SKIP = X._SKIPPED.replace("'", "''")


def _token_list() -> str:
    """Kept tokens of an article, piece by piece: a template is one token, other text is cut."""
    parts = []
    for p in D.PIECES:
        for part in p.parts:
            if isinstance(part, D.T):
                tokens = f"[{part.sql}]"
            else:
                tokens = f"regexp_extract_all(regexp_replace({part}, '{_SKIP}', ' ', 'g'), '{_TOKEN}')"
            parts.append(f"CASE WHEN {p.cond} THEN {tokens} ELSE [] END")
    every = f"flatten([{', '.join(parts)}])"
    kept = ", ".join(f"'{c}'" for c in X.KEPT_SIGNS)
    return f"list_filter({every}, lambda t: length(t) > 1 OR t IN ({kept}))"


# The regular expressions hold braces of their own, so only the wiki braces are replaced here.
_TOKENS = (
    "WITH a AS ("
    + D.duck(D._ARTICLE_BASE)
    + ") SELECT ok AS page_id, "
    + _token_list().replace("«", "{").replace("»", "}")
    + " AS tokens FROM a"
)
_TAG = """CASE WHEN t LIKE '{{%' THEN 'WIKICODE' WHEN regexp_matches(t, '^[0-9][0-9.,:%-]*$') THEN 'NUM'
  WHEN regexp_matches(t, '^[^\\w\\s]+$') THEN 'PUNCT' WHEN regexp_matches(t, '^\\p{Lu}') THEN 'CAP' ELSE 'WORD' END"""
_AT = "list_position(tokens, c)"
_NEAR = f"list_slice(tokens, greatest({_AT} - 40, 1), {_AT} - 1)"
_FEATURES = f"""SELECT page_id, c AS citation, CAST({_AT} - 1 AS BIGINT) AS ref_index, CAST(len(tokens) AS BIGINT) AS total_words,
    CASE WHEN {_AT} > 1 THEN {_NEAR} ELSE [] END AS near
  FROM (SELECT page_id, tokens, unnest(list_filter(tokens, lambda t: t LIKE '{{{{%')) AS c FROM ({_TOKENS}) k) u"""


def features(spark, sf):
    return X.explode_features(X.context_features(D.articles(spark, sf).select("page_id", "content")))


@query(f"""SELECT page_id, citation AS retrieved_citation, ref_index, total_words, array_to_string(near, ' ') AS words,
             array_to_string(list_transform(near, lambda t: {_TAG}), ' ') AS tags FROM ({_FEATURES}) f""")
def neighbors_40(spark, sf):
    return features(spark, sf).select(
        "page_id", "retrieved_citation", F.col("ref_index").cast("bigint").alias("ref_index"),
        F.col("total_words").cast("bigint").alias("total_words"),
        F.array_join("neighboring_words", " ").alias("words"), F.array_join("neighboring_tags", " ").alias("tags"),
    )


@query(f"""SELECT CAST(ref_index AS BIGINT) AS ref_index, CAST(count(*) AS BIGINT) AS n FROM ({_FEATURES}) f GROUP BY 1""")
def ref_index(spark, sf):
    return features(spark, sf).groupBy(F.col("ref_index").cast("bigint").alias("ref_index")).agg(F.count("*").alias("n"))


_KEPT = ", ".join(f"'{c}'" for c in X.KEPT_SIGNS)
_DOC_TOKENS = f"""SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS t FROM documents) q
  WHERE length(t) > 1 OR t IN ({_KEPT})"""


@query(f"""SELECT tag, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM
             (SELECT doc_id, {_TAG} AS tag FROM ({_DOC_TOKENS}) d) e GROUP BY tag""")
def token_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = X.token_rows(docs, "text", X.word_tokens("text"))
    # One row per document and class first, so that the distinct count moves little.
    per_doc = rows.groupBy("tag", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("tag").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


_LOWER = f"SELECT doc_id, lower(t) AS w FROM ({_DOC_TOKENS}) d"


@query(f"""SELECT w.doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (f.w IS NULL) AS BIGINT) AS n_unk
           FROM ({_LOWER}) w LEFT JOIN (SELECT w FROM ({_LOWER}) x GROUP BY w HAVING count(*) > 4) f ON w.w = f.w
           GROUP BY w.doc_id""")
def unk_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lists = docs.select("doc_id", X.filter_tokens(X.clean_tokens(X.word_tokens("text"))).alias("words"))
    done = X.unk_rare_words(X.lowercase_words(lists, "words"), "doc_id", "words")
    return done.select(
        "doc_id", F.size("words").cast("bigint").alias("n"),
        F.size(F.filter("words", lambda w: w == X.UNKNOWN)).cast("bigint").alias("n_unk"),
    )


_WITH_SECTIONS = f"""SELECT page_id, text, min(ord) AS ord, list(section) AS sections FROM ({TEMPLATES}) t GROUP BY page_id, text"""


@query(f"""SELECT section AS section_name, CAST(count(*) AS BIGINT) AS "count" FROM ({TEMPLATES}) t GROUP BY section
           ORDER BY 2 DESC, 1 LIMIT 3""")
def top_sections(spark, sf):
    found = O.extract_citations(D.articles(spark, sf)).select(F.array("section").alias("sections"))
    return X.top_sections(found, "sections", 3)


@query(f"""SELECT page_id, text AS citations, CAST(CASE WHEN list_contains(sections, 'History') THEN 1 ELSE 0 END AS BIGINT) AS "History",
             CAST(CASE WHEN list_contains(sections, 'References') THEN 1 ELSE 0 END AS BIGINT) AS "References",
             CAST(CASE WHEN list_has_any(sections, ['Initial Section', 'Early years']) THEN 1 ELSE 0 END AS BIGINT) AS others
           FROM ({_WITH_SECTIONS}) s""")
def section_dummies(spark, sf):
    found = O.extract_citations(D.articles(spark, sf)).select(
        "page_id", "citations", F.array_sort(F.array_distinct("sections_all")).alias("sections")
    ).distinct()
    done = X.encode_sections(found, ["History", "References"])
    return done.select("page_id", "citations", *[F.col(c).cast("bigint").alias(c) for c in ("History", "References", "others")])


_ALL_SECTIONS = ["History", "Initial Section", "References", "Early years"]
_BY_SECTION = ", ".join(f"CAST(CASE WHEN list_contains(sections, '{x}') THEN 1 ELSE 0 END AS BIGINT) AS \"{x}\"" for x in _ALL_SECTIONS)


@query(f"SELECT page_id, text AS citations, {_BY_SECTION}, CAST(0 AS BIGINT) AS others FROM ({_WITH_SECTIONS}) s")
def section_dummies_whole(spark, sf):
    """A column for each of the most frequent sections, as many as the operator takes by default."""
    found = O.extract_citations(D.articles(spark, sf)).select("page_id", "citations", "section", "sections_all")
    top = [r.section_name for r in X.top_sections(found.select(F.array("section").alias("sections"))).collect()]
    rows = found.select("page_id", "citations", F.array_sort(F.array_distinct("sections_all")).alias("sections")).distinct()
    done = X.encode_sections(rows, top)
    return done.select("page_id", "citations", *[F.col(c).cast("bigint").alias(c) for c in [*top, "others"]])


_TAG_COLUMNS = ["WORD", "CAP", "NUM", "PUNCT", "WIKICODE"]
_COUNTED = ", ".join(
    f"CAST(len(list_filter(tags, lambda t: t = '{k}')) AS BIGINT) AS \"{k}\"" for k in _TAG_COLUMNS
)


@query(f"""SELECT page_id, ref_index, {_COUNTED}, CAST(0 AS BIGINT) AS others FROM (SELECT page_id, ref_index,
             list_transform(near, lambda t: {_TAG}) AS tags FROM ({_FEATURES}) f) g""")
def tag_counts(spark, sf):
    rows = features(spark, sf).select("page_id", F.col("ref_index").cast("bigint").alias("ref_index"), "neighboring_tags")
    done = X.encode_tags(rows, _TAG_COLUMNS)
    return done.select("page_id", "ref_index", *[F.col(c).cast("bigint").alias(c) for c in [*_TAG_COLUMNS, "others"]])


_SOME_TYPES = ["cite journal", "cite book", "cite web", "cite news"]


@query(f"""SELECT page_id, {', '.join(f'''CAST(CASE WHEN typ = '{t}' THEN 1 ELSE 0 END AS BIGINT) AS "{t}"''' for t in _SOME_TYPES)}
           FROM {LABELLED} l""")
def type_dummies(spark, sf):
    rows = O.filter_known_types(cites(spark, sf)).select("page_id", F.col("type_of_citation").alias("citation_type"))
    done = X.encode_citation_type(rows, _SOME_TYPES)
    return done.select("page_id", *[F.col(c).cast("bigint").alias(c) for c in _SOME_TYPES])


_BY_TYPE = ", ".join(f"CAST(CASE WHEN typ = '{t}' THEN 1 ELSE 0 END AS BIGINT) AS \"{t}\"" for t in CITATION_TYPES)


@query(f"SELECT page_id, {_BY_TYPE} FROM {LABELLED} l")
def type_dummies_whole(spark, sf):
    """A column for each known type."""
    rows = O.filter_known_types(cites(spark, sf)).select("page_id", F.col("type_of_citation").alias("citation_type"))
    done = X.encode_citation_type(rows, list(CITATION_TYPES))
    return done.select("page_id", *[F.col(c).cast("bigint").alias(c) for c in CITATION_TYPES])


@query(f"SELECT page_id, citation FROM (SELECT page_id, citation FROM ({_FEATURES}) f) g ORDER BY page_id, citation LIMIT 20")
def first_citations(spark, sf):
    return X.head(features(spark, sf).select("page_id", F.col("retrieved_citation").alias("citation")), 20, "page_id", "citation")


# --- joins ---------------------------------------------------------------------------------------------------

_OUTER = f"SELECT page_id, text, section FROM ({TEMPLATES}) t WHERE depth = 1"


_JOINED = f"""SELECT f.page_id, o.section, f.ref_index, f.total_words FROM ({_OUTER}) o JOIN ({_FEATURES}) f
           ON o.page_id = f.page_id AND o.text = f.citation"""


@query(_JOINED)
def join_features(spark, sf):
    """Every occurrence of a text on a page meets every context of that text on the page."""
    pages = D.articles(spark, sf)
    found = O.extract_citations(pages.select("page_id", "content")).select(
        F.col("page_id").alias("id"), "citations", "section"
    )
    done = X.join_features(found, features(spark, sf))
    return done.select(
        "page_id", "section", F.col("ref_index").cast("bigint").alias("ref_index"),
        F.col("total_words").cast("bigint").alias("total_words"),
    )


@query(_JOINED)
def join_features_bucketed(spark, sf):
    """The same from stage tables in buckets of page and text."""
    pages = D.articles(spark, sf)
    found = O.extract_citations(pages.select("page_id", "content")).select(F.col("page_id").alias("id"), "citations", "section")
    left = bucketed_stage(found, scratch_path(spark, "citations"), ["id", "citations"])
    near = features(spark, sf).select("page_id", "retrieved_citation", "ref_index", "total_words")
    right = bucketed_stage(near, scratch_path(spark, "features"), ["page_id", "retrieved_citation"])
    done = X.join_features_bucketed(left, right)
    return done.select(
        "page_id", "section", F.col("ref_index").cast("bigint").alias("ref_index"),
        F.col("total_words").cast("bigint").alias("total_words"),
    )


@query(f"""SELECT f.page_id, l.text AS citations FROM ({_FEATURES}) f JOIN (SELECT DISTINCT text FROM ({_OUTER}) o
           WHERE text LIKE '{{{{cite journal%' OR text LIKE '{{{{lang%') l ON f.citation = l.text""")
def join_selected(spark, sf):
    pages = D.articles(spark, sf).select("page_id", "content")
    chosen = (
        O.extract_citations(pages)
        .where(F.col("type_of_citation").isin("cite journal", "lang"))
        .select("citations")
        .distinct()
    )
    return X.join_selected(features(spark, sf), chosen).select("page_id", "citations")


@query(f"""SELECT page_id, (CASE WHEN pk % 2 = 0 THEN doi ELSE 'none' END) IS NOT DISTINCT FROM doi AS same
           FROM {LABELLED} l WHERE doi IS NOT NULL""")
def same_identifier(spark, sf):
    """Found identifier against the known ones: the DOI itself for even parts, else something not there."""
    rows = with_id_list(spark, sf).select("page_id", "ID_list", C.alias("params", "Title").alias("t")).where(
        F.try_element_at("ID_list", F.lit("DOI")).isNotNull()
    )
    even = F.regexp_extract("t", r"Study (\d+)", 1).cast("bigint") % 2 == 0
    value = F.when(even, F.try_element_at("ID_list", F.lit("DOI"))).otherwise("none")
    acquired = F.array(F.struct(F.lit("doi").alias("type"), value.alias("value")))
    return rows.withColumn("acquired", acquired).select("page_id", K.same_identifier("ID_list", "acquired").alias("same"))


# --- record look-up ------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN 2.0 * l / (2 * l + 2) WHEN 1 THEN 2.0 * (l - 1) / (2 * l - 1)
            WHEN 2 THEN 2.0 * (l - 1) / (2 * l) ELSE 1.0 END, 6) AS ratio, TRUE AS bounded
          FROM (SELECT p_partkey, length(p_name) AS l FROM part) q""")
def similarity_ratio(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name")
    rest = F.substr("p_name", F.lit(2))
    edited = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("##")))
        .when(F.col("p_partkey") % 4 == 1, rest)
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("#"), rest))
        .otherwise(F.col("p_name"))
    )
    pairs = part.withColumn("edited", edited).withColumn("ratio", S.similarity_ratio("p_name", "edited"))
    low = F.least(S.ratio_bound("p_name", "edited"), S.length_bound("p_name", "edited"))
    return pairs.select("p_partkey", F.round("ratio", 6).alias("ratio"), (low >= F.col("ratio") - 1e-9).alias("bounded"))


_REC = f"({D.duck(D.RECORDS)})"
_ISBN = "'isbn_13:978' || lpad(CAST(pk AS VARCHAR), 10, '0')"


def _ids_text(column):
    return F.array_join(F.transform(column, lambda i: F.concat(i["type"], F.lit(":"), i["value"])), ";")


@query(f"""SELECT pk, CASE pk % 6 WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN query_title || 'abc' ELSE query_title END AS title,
             CASE pk % 6 WHEN 0 THEN {_ISBN} WHEN 1 THEN {_ISBN} WHEN 3 THEN '' WHEN 5 THEN {_ISBN} || ';other:X' || CAST(pk AS VARCHAR) END AS ids,
             CASE pk % 6 WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN round(2.0 * length(query_title) / (2 * length(query_title) + 3), 6) ELSE 1.0 END AS ratio,
             CAST(CASE pk % 6 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 4 THEN 0 ELSE 1 END AS BIGINT) AS n_scanned FROM {_REC} r""")
def best_candidate(spark, sf):
    rows = D.records(spark, sf).withColumn("c", K.parse_books("books"))
    done = K.best_candidate(rows, "query_title", "c")
    return done.select(
        "pk", F.col("best.title").alias("title"), _ids_text("best.ids").alias("ids"),
        F.round("best.ratio", 6).alias("ratio"), F.col("n_scanned").cast("bigint").alias("n_scanned"),
    )


@query(f"""SELECT pk, CASE pk % 4 WHEN 0 THEN 'DOI:10.5/' || CAST(pk AS VARCHAR)
             WHEN 3 THEN 'DOI:10.8/' || CAST(pk AS VARCHAR) || ';ISBN:1, 2;PMID:' || CAST(pk AS VARCHAR) END AS ids FROM {_REC} r""")
def first_candidate(spark, sf):
    rows = D.records(spark, sf).withColumn("c", K.parse_works("works"))
    done = K.first_candidate(rows, "query_title", "c")
    return done.select("pk", F.when(F.col("best").isNotNull(), _ids_text("best.ids")).alias("ids"))


# A record title per part, far from all others; the citation asks for it with up to two edits, or for one that has no record.
_TITLES = "SELECT p_partkey AS pk, substr(p_name, 1, 20) || ' ' || md5(CAST(p_partkey AS VARCHAR)) AS t FROM part"


@query(f"""SELECT pk, CASE WHEN pk % 6 <> 5 THEN t END AS match,
             round(CASE pk % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 * (n - 1) / (2 * n - 1) WHEN 2 THEN 2.0 * n / (2 * n + 1)
               WHEN 3 THEN 2.0 * (n - 1) / (2 * n) WHEN 4 THEN 2.0 * (n - 2) / (2 * n - 2) END, 6) AS ratio
           FROM (SELECT *, length(t) AS n FROM ({_TITLES}) q) r""")
def match_candidates(spark, sf):
    """Titles with one or two characters missing, added or changed against all records."""
    name = F.concat(F.substr("p_name", F.lit(1), F.lit(20)), F.lit(" "), F.md5(F.col("p_partkey").cast("string")))
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("pk"), name.alias("t"))
    at = (F.length("t") - 30 + F.col("pk") % 20).cast("int")
    head, rest = F.substr("t", F.lit(1), at - 1), F.substr("t", at + 1, F.length("t"))
    kind = F.col("pk") % 6
    asked = (
        F.when(kind == 0, F.col("t"))
        .when(kind == 1, F.concat(head, rest))
        .when(kind == 2, F.concat(head, F.lit("é"), F.substr("t", at, F.length("t"))))
        .when(kind == 3, F.concat(head, F.lit("é"), rest))
        .when(kind == 4, F.concat(F.substr("t", F.lit(2), at - 2), rest))
        .otherwise(F.reverse("t"))
    )
    found = MT.match_candidates(rows.select("pk", asked.alias("Title")), rows.where(kind != 5).select(F.col("t").alias("title")))
    return found.select("pk", "match", F.round("ratio", 6).alias("ratio"))


@query(f"""SELECT pk, CASE pk % 4 WHEN 2 THEN '{K.NO_RESULT}' END AS message,
             CASE pk % 4 WHEN 1 THEN '%%%%%%%%' WHEN 2 THEN NULL ELSE query_title END AS titles FROM {_REC} r""")
def top_candidates(spark, sf):
    rows = D.records(spark, sf).withColumn("c", K.parse_works("works"))
    done = K.top_k_results(rows, "c", 1)
    titles = F.array_join(F.transform("c", lambda x: F.regexp_replace(x["title"], "zz$", "")), "|")
    return done.select("pk", "message", titles.alias("titles"))


@query(f"""SELECT pk, CASE pk % 4 WHEN 2 THEN '{K.NO_RESULT}' END AS message,
             CASE pk % 4 WHEN 0 THEN query_title WHEN 1 THEN '%%%%%%%%|' || query_title WHEN 3 THEN query_title || 'zz' END AS titles,
             CASE pk % 4 WHEN 0 THEN 'DOI:10.5/' || n WHEN 1 THEN 'DOI:10.6/' || n || '|DOI:10.7/' || n
               WHEN 3 THEN 'DOI:10.8/' || n || ';ISBN:1, 2;PMID:' || n END AS ids
           FROM (SELECT *, CAST(pk AS VARCHAR) AS n FROM {_REC} r) q""")
def top_candidates_whole(spark, sf):
    """As many candidates as the operator keeps by default, with titles and identifiers as they are."""
    rows = K.top_k_results(D.records(spark, sf).withColumn("c", K.parse_works("works")), "c")
    titles = F.array_join(F.transform("c", lambda x: x["title"]), "|")
    return rows.select("pk", "message", titles.alias("titles"), F.array_join(F.transform("c", lambda x: _ids_text(x["ids"])), "|").alias("ids"))


@query(f"""SELECT pk, string_agg(kind || ':' || value, ';' ORDER BY item, i) AS ids FROM (
             SELECT pk, item, i, lower(json_extract_string(v, '$.type')) AS kind, json_extract_string(v, '$.identifier') AS value
             FROM (SELECT pk, item, unnest(list_value(0, 1)) AS i, json_extract(books, '$.items[' || item || '].volumeInfo.industryIdentifiers[' || i || ']') AS v
                   FROM (SELECT pk, books, unnest(list_value(0, 1, 2)) AS item FROM {_REC} r) a) b WHERE v IS NOT NULL) c GROUP BY pk""")
def google_ids(spark, sf):
    rows = D.records(spark, sf).select("pk", F.flatten(F.transform(K.parse_books("books"), lambda v: v["ids"])).alias("ids"))
    return rows.where(F.size("ids") > 0).select("pk", _ids_text("ids").alias("ids"))


@query(f"""SELECT pk, 'DOI:' || json_extract_string(works, '$.message.items[0].DOI') ||
             coalesce(';PMID:' || json_extract_string(works, '$.message.items[0].PMID'), '') AS ids FROM {_REC} r
           WHERE json_extract(works, '$.message.items[0]') IS NOT NULL""")
def crossref_ids(spark, sf):
    rows = D.records(spark, sf).select("pk", F.try_element_at(K.parse_works("works"), F.lit(1))["ids"].alias("ids"))
    some = rows.where(F.col("ids").isNotNull())
    return some.select("pk", _ids_text(F.filter("ids", lambda i: i["type"] != "ISBN")).alias("ids"))


@query(f"""SELECT pk, CASE pk % 4 WHEN 0 THEN 'DOI:10.5/' || n WHEN 1 THEN 'DOI:10.6/' || n
             WHEN 3 THEN 'DOI:10.8/' || n || ';ISBN:1, 2;PMID:' || n END AS ids
           FROM (SELECT pk, CAST(pk AS VARCHAR) AS n FROM {_REC} r) q WHERE pk % 4 <> 2""")
def crossref_ids_whole(spark, sf):
    """Identifiers of the first record, ISBNs too."""
    rows = D.records(spark, sf).select("pk", F.try_element_at(K.parse_works("works"), F.lit(1))["ids"].alias("ids"))
    return rows.where(F.col("ids").isNotNull()).select("pk", _ids_text("ids").alias("ids"))


_LIKELY = "label = 'other' AND typ IN ('cite book', 'cite journal', 'cite encyclopedia', 'cite proceedings')"
_TITLE = "CASE WHEN slot = 23 THEN encyclopedia WHEN title_style = 2 THEN plain_title || ' ' ELSE plain_title END"
_ACQUIRED = f"""(SELECT l.*, r.pk AS rk, CASE WHEN {_LIKELY} AND r.pk IS NOT NULL THEN
    CASE WHEN r.pk % 4 = 0 THEN 'DOI:10.5/' || CAST(r.pk AS VARCHAR)
         WHEN r.pk % 4 = 3 THEN 'DOI:10.8/' || CAST(r.pk AS VARCHAR) || ';ISBN:1, 2;PMID:' || CAST(r.pk AS VARCHAR)
         WHEN r.pk % 6 IN (0, 1) THEN 'isbn_13:978' || lpad(CAST(r.pk AS VARCHAR), 10, '0')
         WHEN r.pk % 6 = 5 THEN 'isbn_13:978' || lpad(CAST(r.pk AS VARCHAR), 10, '0') || ';other:X' || CAST(r.pk AS VARCHAR)
         ELSE '' END ELSE '' END AS acquired
  FROM {LABELLED} l LEFT JOIN {_REC} r ON r.query_title = {_TITLE})"""


def disambiguated(spark, sf):
    rows = L.label_book_journal(normalized_cites(spark, sf, ["Title", "ID_list"])).select(
        "page_id", "type_of_citation", "Title", "actual_label"
    )
    rows = materialize(rows, "labelled")
    answers = D.records(spark, sf)
    works = answers.select("query_title", F.col("works").alias("response"))
    books = answers.select("query_title", F.col("books").alias("response"))
    return K.disambiguate(rows, works, books)


@query(f"SELECT page_id, label AS actual_label, acquired FROM {_ACQUIRED} a")
def disambiguate(spark, sf):
    return disambiguated(spark, sf).select("page_id", "actual_label", _ids_text("acquired_ID_list").alias("acquired"))


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (label <> 'other') AS BIGINT) AS labelled,
             CAST(count(*) FILTER (label = 'other') AS BIGINT) AS unlabelled, CAST(count(*) FILTER ({_LIKELY}) AS BIGINT) AS likely,
             CAST(count(*) FILTER (acquired <> '') AS BIGINT) AS added FROM {_ACQUIRED} a""")
def lookup_stats(spark, sf):
    return K.lookup_stats(disambiguated(spark, sf))


@query(f"SELECT typ AS type_of_citation, CAST(count(*) AS BIGINT) AS n FROM {LABELLED} l WHERE {_LIKELY} GROUP BY typ")
def lookup_candidates(spark, sf):
    return K.lookup_candidates(labelled_cites(spark, sf)).groupBy("type_of_citation").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row_no,
            CAST(floor((row_number() OVER (ORDER BY p_partkey) - 1) / 75) AS BIGINT) AS batch FROM part""")
def request_batches(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    done = K.request_batches(part, "p_partkey")
    return done.select("p_partkey", F.col("row_no").cast("bigint").alias("row_no"), F.col("batch").cast("bigint").alias("batch"))


@query("""SELECT s_suppkey, 'bibliographic=' || s_name || ';author=' || s_name AS params,
            'https://www.googleapis.com/books/v1/volumes?q=' || replace(s_name, '#', '%23') || '+inauthor:' || replace(s_name, '#', '%23')
              || '+intitle:' || replace(s_name, '#', '%23') AS books,
            'https://api.crossref.org/works?rows=1&query.author=' || replace(s_name, '#', '%23') || '&query.title=' || replace(s_name, '#', '%23') AS works,
            'https://www.googleapis.com/books/v1/volumes?q=oclc:' || CAST(s_suppkey AS VARCHAR) AS by_id
          FROM supplier WHERE s_nationkey <> 3""")
def request_urls(spark, sf):
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(
        "s_suppkey", "s_name", F.when(F.col("s_nationkey") != 3, F.col("s_name")).alias("author")
    )
    params = K.request_params(rows, "s_suppkey", "s_name", "author")
    text = F.concat(
        F.lit("bibliographic="), F.col("params")["query.bibliographic"], F.lit(";author="), F.col("params")["query.author"]
    )
    urls = K.request_urls("s_name", "author")
    return (
        rows.join(params, "s_suppkey")
        .select(
            "s_suppkey", text.alias("params"), urls["books"].alias("books"), urls["works"].alias("works"),
            K.id_request_url(F.lit("OCLC"), F.col("s_suppkey").cast("string")).alias("by_id"),
        )
    )


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)""")
def pending_requests(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    done = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return K.pending_requests(part, done, "p_partkey")


# --- features ------------------------------------------------------------------------------------------------

_BLANKED = "citation"
for _name in M.BIASED:
    _BLANKED = f"regexp_replace({_BLANKED}, '{_name}\\s{{0,10}}=\\s{{0,10}}([^|]+)', '{_name} = ', 'g')"
_DROPPED = _BLANKED
for _name in M.BIASED:
    _DROPPED = f"replace({_DROPPED}, '{_name} = ', '')"
_SHARE = "CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 12) AS BIGINT) % 1000"


@query(f"""SELECT page_id, CASE WHEN {_SHARE} < 300 THEN {_DROPPED} ELSE {_BLANKED} END AS citations FROM {_P} p""")
def clear_bias(spark, sf):
    rows = cites(spark, sf).select("page_id", F.col("citation").alias("citations"), "type_of_citation")
    return M.clear_bias(rows, "page_id", 0.3)


def labelled_set(spark, sf):
    """Books and journals by rule, news by domain: id, citations, label."""
    done = L.label_news(labelled_cites(spark, sf), news_domains(spark, sf)).select(
        F.col("page_id").alias("id"), F.col("citation").alias("citations"), "actual_label"
    )
    done = materialize(done, "labelled")  # both parts read it
    return M.labelled_dataset(done, done.where(F.col("actual_label") == "news").drop("actual_label"))


_SET = f"""SELECT DISTINCT page_id AS id, citation AS citations, final AS actual_label FROM {_NEWS} n WHERE final <> 'other'"""


@query(f"""SELECT id, citations, actual_label, CAST(CASE actual_label WHEN 'book' THEN 0 WHEN 'journal' THEN 1 ELSE 2 END AS BIGINT) AS label_category
           FROM ({_SET}) s""")
def labelled_dataset(spark, sf):
    done = labelled_set(spark, sf)
    return done.withColumn("label_category", F.col("label_category").cast("bigint"))


_CHARS = f"SELECT ch AS char, count(*) AS n FROM (SELECT unnest(string_split(citation, '')) AS ch FROM {_P} p) q GROUP BY ch"


@query(f"SELECT char, CAST(n AS BIGINT) AS n FROM ({_CHARS}) c")
def char_counts(spark, sf):
    return M.char_counts(D.citations(spark, sf), "citation")


@query(f"""SELECT page_id, array_to_string(list_slice(list_concat(list_transform(range(400), lambda x: 0), list_transform(string_split(citation, ''),
             lambda ch: m[ch])), -400, -1), ',') AS ids
           FROM (SELECT page_id, citation FROM {_P} p) q, (SELECT map(list(char ORDER BY char), list(idx ORDER BY char)) AS m FROM (SELECT char,
             row_number() OVER (ORDER BY n DESC, char) - 1 AS idx FROM ({_CHARS}) c) i) x""")
def char_sequence(spark, sf):
    rows = D.citations(spark, sf).select("page_id", "citation")
    index = M.char_index(M.char_counts(rows, "citation"))
    done = M.char_sequence(rows, index, "citation")
    return done.select("page_id", F.array_join(F.col("char_ids").cast("array<string>"), ",").alias("ids"))


@query(f"""SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(words), 6) AS mean_words, round(median(words), 6) AS median_words
           FROM (SELECT label, length(citation) AS words FROM {LABELLED} l) q GROUP BY label""")
def length_stats(spark, sf):
    rows = labelled_cites(spark, sf).select(F.col("actual_label").alias("label"), F.length("citation").alias("words"))
    done = M.length_stats(rows, "label", "words")
    return done.select("label", "n", F.round("mean_words", 6).alias("mean_words"), F.round("median_words", 6).alias("median_words"))


@query(f"""SELECT CAST(max(length(citation)) AS BIGINT) AS max_chars, round(avg(length(citation)), 6) AS mean_chars,
             round(median(length(citation)), 6) AS median_chars FROM {_P} p""")
def char_length_stats(spark, sf):
    done = M.char_length_stats(D.citations(spark, sf), "citation")
    return done.select(
        F.col("max_chars").cast("bigint").alias("max_chars"), F.round("mean_chars", 6).alias("mean_chars"),
        F.round("median_chars", 6).alias("median_chars"),
    )


@query(f"""SELECT label, CASE WHEN {_SHARE} < 900 THEN 'train' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS n
           FROM {LABELLED} l GROUP BY 1, 2""")
def stratified_split(spark, sf):
    rows = M.stratified_split(labelled_cites(spark, sf).select("page_id", F.col("actual_label").alias("label")), "page_id")
    return rows.groupBy("label", "split").agg(F.count("*").alias("n"))


_ORDER = "CAST('0x' || substr(md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), 1, 15) AS BIGINT)"


@query(f"""SELECT k, label, CASE WHEN r <= greatest(1, least(n - 1, round(n * 0.9))) THEN 'train' ELSE 'test' END AS split
           FROM (SELECT l_orderkey * 10 + l_linenumber AS k, lab AS label, row_number() OVER (PARTITION BY lab ORDER BY {_ORDER}) AS r,
                   count(*) OVER (PARTITION BY lab) AS n
                 FROM (SELECT *, CASE WHEN l_orderkey = 1 THEN 'rare' WHEN l_quantity < 3 THEN NULL ELSE l_returnflag || l_linestatus END AS lab
                       FROM lineitem) a) b""")
def stratified_split_per_label(spark, sf):
    """Nine tenths of every label, exactly; a label of a few rows is on both sides."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        F.when(F.col("l_orderkey") == 1, "rare").when(F.col("l_quantity") >= 3, F.concat("l_returnflag", "l_linestatus")).alias("label"),
    )
    return M.stratified_split(rows, "k", label="label")


@query("""SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels""")
def accuracy(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("quality", "toxic")
    done = M.accuracy(labels, "quality", "toxic")
    return done.select("n", F.round("accuracy", 6).alias("accuracy"))


@query("""SELECT CAST(quality AS BIGINT) AS label, CAST(count(*) FILTER (toxic = 0) AS BIGINT) AS predicted_0,
            CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS predicted_1, CAST(count(*) FILTER (toxic = 2) AS BIGINT) AS predicted_2
          FROM labels GROUP BY quality""")
def confusion(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("quality", "toxic")
    return M.confusion(labels, "quality", "toxic").withColumn("label", F.col("label").cast("bigint"))


@query(f"""SELECT page_id, label AS rule_label, CAST(NULL AS BIGINT) AS predicted FROM {LABELLED} l WHERE label <> 'other'
           UNION ALL SELECT page_id, CAST(NULL AS VARCHAR), CAST(2 AS BIGINT) FROM {LABELLED} l WHERE label = 'other'""")
def merge_predictions(spark, sf):
    yes, no = L.split_labelled(labelled_cites(spark, sf).select("page_id", "actual_label"))
    rule = yes.select("page_id", F.col("actual_label").alias("rule_label"))
    model = no.select("page_id", F.lit(2).cast("bigint").alias("predicted"))
    return M.merge_predictions(rule, model)


@query(f"""SELECT l.page_id, l.label, f.n_chars FROM (SELECT page_id, citation, label FROM {LABELLED} l) l
           JOIN (SELECT DISTINCT page_id, citation, CAST(length(citation) AS BIGINT) AS n_chars FROM {LABELLED} l) f
             ON l.page_id = f.page_id AND l.citation = f.citation""")
def join_by_key(spark, sf):
    rows = labelled_cites(spark, sf).select("page_id", "citation", F.col("actual_label").alias("label"))
    rows = materialize(rows, "labelled")  # both sides read it
    lengths = rows.select("page_id", "citation", F.length("citation").cast("bigint").alias("n_chars")).distinct()
    return M.join_by_key(rows, lengths, ["page_id", "citation"]).select("page_id", "label", "n_chars")


# --- models (no SQL counterpart) -----------------------------------------------------------------------------


@query()
def word_vectors(spark, sf):
    """Vectors trained on the documents, summed per document."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lists = docs.select("doc_id", F.transform(X.filter_tokens(X.word_tokens("text")), lambda w: F.lower(w)).alias("words"))
    model = ML.train_word_vectors(lists, "words")
    done = ML.word_vector_sum(lists, model, "words")
    return done.select("doc_id", F.size("words").alias("n_words"), "words_embedding")


@query()
def char_embedding_sum(spark, sf):
    """Sum of per-label mean vectors of the embeddings over the digits of an order, scaled to length one."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = ML.array_vector(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding", "v").groupBy(
        F.col("label").cast("string").alias("item")
    ).agg(Summarizer.mean(F.col("v")).alias("vector"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.split(F.col("o_orderkey").cast("string"), "").alias("items")
    )
    done = ML.embedding_sum(orders, "o_orderkey", "items", vectors)
    return done.select("o_orderkey", F.when(F.col("embedding").isNotNull(), vector_to_array("embedding")).alias("embedding"))


@query()
def pca(spark, sf):
    rows = ML.array_vector(spark.read.parquet(f"{sf}/embeddings.parquet"), "embedding", "v")
    return ML.reduce_dims(rows.select("vec_id", "v"), "v", 5).select("vec_id", "reduced")


def _training(spark, sf):
    rows = labelled_set(spark, sf)
    cleared = M.clear_bias(rows.withColumn("type_of_citation", F.lit("")), "id", 1.0)
    return materialize(M.stratified_split(cleared, "id"), "training")


@query()
def text_classifier(spark, sf):
    """Confusion on the test share of a model trained on citation characters."""
    rows = _training(spark, sf)
    model = ML.train_text_classifier(rows.where("split = 'train'"))
    return M.confusion(ML.predict(rows.where("split = 'test'"), model, "citations"))


@query()
def context_classifier(spark, sf):
    """Type of a citation from its surroundings: word classes before it and its place."""
    rows = X.encode_tags(features(spark, sf), _TAG_COLUMNS)
    kind = C.citation_type("retrieved_citation")
    labelled = rows.withColumn(
        "label_category", F.when(kind == "cite book", 0).when(kind == "cite journal", 1).otherwise(2)
    )
    # Training and test share the pages' parse.
    labelled = materialize(labelled.select("page_id", "label_category", *_TAG_COLUMNS, "ref_index", "total_words"), "context")
    ready = ML.assemble(labelled, [*_TAG_COLUMNS, "ref_index", "total_words"])
    split = M.stratified_split(ready, "page_id")
    model = ML.train_context_classifier(split.where("split = 'train'"), 7)
    return M.confusion(ML.predict(split.where("split = 'test'"), model))


@query()
def sampled_citations(spark, sf):
    return M.sample_with_replacement(cites(spark, sf), 0.1, seed=0).groupBy("type_of_citation").agg(F.count("*").alias("n"))


# --- streams (no SQL counterpart) ----------------------------------------------------------------------------


@query("""SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS start, event_type AS label, CAST(count(*) AS BIGINT) AS n
          FROM events GROUP BY 1, 2""")
def stream_label_counts(spark, sf):
    """Events per day and type from a file stream that stops when all files are read."""
    target = scratch_path(spark, "counts")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    run = ST.stream_label_counts(
        spark, sf, schema, target, scratch_path(spark, "mark"), "ts", "event_type", pattern="events.parquet"
    )
    run.awaitTermination()
    counts = spark.read.schema("start timestamp, label string, n bigint").parquet(target)
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "label", "n")


@query()
def stream_dump_parts(spark, sf):
    """Articles as a stream of files through extraction, normalising and labelling."""
    pages = D.articles(spark, sf)
    source = pages.inputFiles()[0].rsplit("/", 1)[0]
    target = scratch_path(spark, "labelled")
    run = ST.stream_dump_parts(spark, source, pages.schema, target, scratch_path(spark, "mark"))
    run.awaitTermination()
    return spark.read.parquet(target).groupBy("actual_label").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, final AS actual_label FROM {_NEWS} n")
def stream_news_labels(spark, sf):
    """Articles of one citation each as a stream of files, labelled to the end with a domain table that every batch reads."""
    pages = D.citations(spark, sf).select("page_id", "page_title", repair_unbalanced("citation").alias("content"))
    source, domains, target = scratch_path(spark, "pages"), scratch_path(spark, "domains"), scratch_path(spark, "labelled")
    pages.write.parquet(source)
    news_domains(spark, sf).write.parquet(domains)
    run = ST.stream_dump_parts(spark, source, pages.schema, target, scratch_path(spark, "mark"), domains=domains)
    run.awaitTermination()
    return spark.read.parquet(target).select("page_id", "actual_label")
