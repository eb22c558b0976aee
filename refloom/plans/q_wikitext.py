"""Queries over articles: wikitext nodes, sections, plain text, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions import wikitext as W
from refloom.functions.core import settle
from refloom.operators import extraction as X
from refloom.operators import rewriting as R
from refloom.operators.citations import extract_citations
from refloom.plans import derived as D
from refloom.plans.registry import query

# --- what the articles hold, stated piece by piece --------------------------------------------------------------


def _template_rows() -> str:
    """page_id, ord, text, depth, parent, section, strict for every template."""
    out = []
    for i, p in enumerate(D.PIECES):
        for t in p.templates:
            out.append(
                f"SELECT ok AS page_id, {i * 10} AS ord, {t} AS text, 1 AS depth, CAST(NULL AS VARCHAR) AS parent,"
                f" '{p.section}' AS section, '{p.strict}' AS strict FROM a WHERE {p.cond}"
            )
            out += [
                f"SELECT ok, {i * 10 + 1}, {n}, 2, {t}, '{p.section}', '{p.strict}' FROM a WHERE {p.cond}"
                for n in p.nested
            ]
    return " UNION ALL ".join(out)


def _rows(select) -> str:
    out = [s for i, p in enumerate(D.PIECES) for s in select(i, p)]
    return " UNION ALL ".join(out)


TEMPLATES = D.duck_pieces(_template_rows())
_LINKS = D.duck_pieces(
    _rows(lambda i, p: [
        f"SELECT ok AS page_id, {i * 10 + j} AS ord, {t} AS title, {x} AS text FROM a WHERE {p.cond}"
        for j, (t, x) in enumerate(p.links)
    ])
)
_URLS = D.duck_pieces(
    _rows(lambda i, p: [
        f"SELECT ok AS page_id, {u} AS url, {t} AS title FROM a WHERE {p.cond}" for u, t in p.urls
    ])
)
_ITEMS = D.duck_pieces(
    _rows(lambda i, p: [
        f"SELECT ok AS page_id, {m} AS markers, {g} AS tag, {t} AS text FROM a WHERE {p.cond}" for m, g, t in p.items
    ])
)
_CELLS = D.duck_pieces(
    _rows(lambda i, p: [
        f"SELECT ok AS page_id, {r} AS row_no, {c} AS cell_no, {h} AS header, {t} AS text FROM a WHERE {p.cond}"
        for r, c, h, t in p.cells
    ])
)
_ARTICLES = D.duck(D.ARTICLES)
_PLAIN = D.duck_pieces(
    "SELECT ok AS page_id, "
    + " || ".join(f"CASE WHEN {p.cond} THEN {p.plain} ELSE '' END" for p in D.PIECES)
    + " AS raw FROM a"
)
_POS = "CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) AS BIGINT)"


@query(f"""SELECT page_id, CAST(count(*) AS BIGINT) AS n, CAST(max(depth) AS BIGINT) AS max_depth
           FROM ({TEMPLATES}) t GROUP BY page_id""")
def templates_per_page(spark, sf):
    spans = B.with_ancestors(B.template_spans("content"))
    return (
        settle(D.articles(spark, sf).select("page_id", spans.alias("s")), ["s"])
        .where(F.size("s") > 0)
        .select(
            "page_id",
            F.size("s").cast("bigint").alias("n"),
            F.array_max(F.transform("s", lambda x: x["depth"])).cast("bigint").alias("max_depth"),
        )
    )


@query(f"SELECT page_id, {_POS} AS pos, text FROM ({TEMPLATES}) t WHERE depth = 1")
def outermost_templates(spark, sf):
    found = X.extract_templates(D.articles(spark, sf), outermost=True)
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "text")


@query(f"SELECT page_id, text, CAST(depth AS BIGINT) AS depth, parent FROM ({TEMPLATES}) t")
def ancestors(spark, sf):
    found = X.parents(X.extract_templates(D.articles(spark, sf)))
    above = found.select("page_id", F.col("start").alias("parent_start"), F.col("text").alias("parent"))
    return found.join(above, ["page_id", "parent_start"], "left").select(
        "page_id", "text", F.col("depth").cast("bigint").alias("depth"), "parent"
    )


@query(f"SELECT page_id, text AS citations, section FROM ({TEMPLATES}) t")
def citations_by_section(spark, sf):
    return X.section_of(D.articles(spark, sf)).select("page_id", F.col("text").alias("citations"), "section")


@query(f"""SELECT strict AS section, CAST(count(*) AS BIGINT) AS n FROM ({TEMPLATES}) t GROUP BY strict""")
def citations_by_section_strict(spark, sf):
    found = X.section_of(D.articles(spark, sf), strict=True)
    return found.groupBy("section").agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, {_POS} AS pos, text AS citations, section,
             string_agg(section, ', ') OVER (PARTITION BY page_id, text ORDER BY ord
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sections,
             lower(trim(regexp_extract(text, '^[{{][{{]([^|}}]*)', 1))) AS type_of_citation
           FROM ({TEMPLATES}) t""")
def extracted_citations(spark, sf):
    found = extract_citations(D.articles(spark, sf))
    return found.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "citations",
        "section",
        F.array_join("sections_all", ", ").alias("sections"),
        "type_of_citation",
    )


_HEADS = D.duck_pieces(
    _rows(lambda i, p: [
        f"SELECT ok AS page_id, {i} AS ord, {p.heading[0]} AS level, '{p.heading[1]}' AS title FROM a WHERE {p.cond}"
    ] if p.heading else [])
)


@query(f"SELECT page_id, {_POS} AS pos, CAST(level AS BIGINT) AS level, title FROM ({_HEADS}) h")
def headings(spark, sf):
    found = X.extract_headings(D.articles(spark, sf))
    return found.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("bigint").alias("level"),
        F.trim("title").alias("title"),
    )


@query(f"SELECT page_id, {_POS} AS pos, title, text FROM ({_LINKS}) l")
def wikilinks(spark, sf):
    found = X.extract_wikilinks(D.articles(spark, sf))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "title", "text")


@query(f"""SELECT page_id, url, title FROM ({_URLS}) u
           UNION ALL SELECT page_id, regexp_extract(text, 'url=([^ |}}]+)', 1), CAST(NULL AS VARCHAR)
           FROM ({TEMPLATES}) t WHERE text LIKE '%url=%'""")
def external_links(spark, sf):
    return X.extract_external_links(D.articles(spark, sf)).select("page_id", "url", "title")


@query(f"""SELECT regexp_extract(url, '^([a-z]+):', 1) AS scheme, CAST(count(*) AS BIGINT) AS n, TRUE AS valid,
             FALSE AS valid_bare FROM ({_URLS}) u GROUP BY 1""")
def link_schemes(spark, sf):
    found = X.extract_external_links(D.articles(spark, sf)).where(
        F.col("title").isNotNull() | F.col("url").contains("bare.")
    )
    return (
        found.groupBy(F.regexp_extract("url", r"^([a-z]+):", 1).alias("scheme"))
        .agg(F.count("*").alias("n"))
        .select("scheme", "n", W.valid_scheme("scheme").alias("valid"), W.valid_scheme("scheme", False).alias("valid_bare"))
    )


@query()
def link_schemes_whole(spark, sf):
    """Schemes of all external links, with and without a title."""
    found = X.extract_external_links(D.articles(spark, sf))
    return (
        found.groupBy(F.regexp_extract("url", r"^([a-z]+):", 1).alias("scheme"))
        .agg(F.count("*").alias("n"))
        .select("scheme", "n", W.valid_scheme("scheme").alias("valid"), W.valid_scheme("scheme", False).alias("valid_bare"))
    )


@query(f"SELECT page_id, markers, tag, text FROM ({_ITEMS}) i")
def list_items(spark, sf):
    return X.extract_list_items(D.articles(spark, sf)).select("page_id", "markers", "tag", "text")


@query(f"""SELECT page_id, CAST(1 AS BIGINT) AS table_no, CAST(row_no AS BIGINT) AS row_no,
             CAST(cell_no AS BIGINT) AS cell_no, header, text FROM ({_CELLS}) c""")
def table_cells(spark, sf):
    found = X.extract_tables(D.articles(spark, sf))
    return found.select(
        "page_id", *[F.col(c).cast("bigint").alias(c) for c in ("table_no", "row_no", "cell_no")], "header", "text"
    )


@query(D.duck_pieces(f"""SELECT ok AS page_id, 'label' AS name, 'none ' || CAST(ok AS VARCHAR) AS "default" FROM a
                         WHERE ok % 8 = 0"""))
def template_arguments(spark, sf):
    return X.extract_arguments(D.articles(spark, sf)).select("page_id", "name", "default")


@query(f"""SELECT page_id, length(text) AS n_chars, text AS plain FROM (
             SELECT page_id, regexp_replace(regexp_replace(regexp_replace(raw, '\\n{{3,}}', chr(10) || chr(10), 'g'),
               '^\\n+', ''), '\\n+$', '') AS text FROM ({_PLAIN}) p) q""")
def plain_text(spark, sf):
    found = X.plain_text(D.articles(spark, sf))
    return found.select("page_id", F.length("plain").cast("bigint").alias("n_chars"), "plain")


# Sections by the heading lines of the text; `rest` starts at the heading.
_LINES = f"""
  SELECT page_id, ln, line, sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY ln) - length(line) - 1 AS at_,
    length(content) AS total, content
  FROM (SELECT page_id, content, unnest(string_split(content, chr(10))) AS line,
          generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM ({_ARTICLES}) x) y
"""
_HEAD_LINES = f"""
  SELECT page_id, at_, total, content, CASE WHEN line LIKE '===%' THEN 3 ELSE 2 END AS level,
    trim(replace(line, '=', '')) AS title, length(line) AS width
  FROM ({_LINES}) z WHERE line LIKE '==%=='
"""


@query(f"""SELECT page_id, CAST(level AS BIGINT) AS level, title,
             substring(content, CAST(at_ + 1 AS BIGINT), CAST(coalesce(nxt, total) - at_ AS BIGINT)) AS text
           FROM (SELECT *, lead(at_) OVER (PARTITION BY page_id ORDER BY at_) AS nxt FROM ({_HEAD_LINES}) h) s
           UNION ALL SELECT page_id, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR),
             substring(max(content), 1, CAST(min(at_) AS BIGINT)) FROM ({_HEAD_LINES}) h GROUP BY page_id""")
def sections_flat(spark, sf):
    found = X.sections(D.articles(spark, sf), flat=True)
    return found.select("page_id", F.col("level").cast("bigint").alias("level"), "title", "text")


@query(f"""SELECT h.page_id, CAST(h.level AS BIGINT) AS level, h.title, length(substring(any_value(h.content), CAST(h.at_ + 1 AS BIGINT),
             CAST(coalesce(min(n.at_), any_value(h.total)) - h.at_ AS BIGINT))) AS n_chars
           FROM ({_HEAD_LINES}) h LEFT JOIN ({_HEAD_LINES}) n
             ON n.page_id = h.page_id AND n.at_ > h.at_ AND n.level <= h.level
           GROUP BY h.page_id, h.level, h.title, h.at_""")
def sections_nested(spark, sf):
    found = X.sections(D.articles(spark, sf), include_lead=False)
    return found.select(
        "page_id", F.col("level").cast("bigint").alias("level"), "title", F.length("text").cast("bigint").alias("n_chars")
    )


@query(f"""SELECT kind, name, CAST(count(*) AS BIGINT) AS n FROM (
             SELECT 'template' AS kind, trim(regexp_extract(text, '^[{{][{{]([^|}}]*)', 1)) AS name
             FROM ({TEMPLATES}) t WHERE text ILIKE '%title=%') q GROUP BY kind, name""")
def filtered_nodes(spark, sf):
    nodes = X.all_nodes(D.articles(spark, sf))
    kept = X.filter_nodes(nodes, kind="template", pattern=r"TITLE=")
    return kept.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query(D.duck_pieces(f"""SELECT page_id, CAST(n AS BIGINT) AS n, CAST(first_pos AS BIGINT) AS first_pos FROM (
    SELECT page_id, count(*) AS n, min(pos) AS first_pos FROM (
      SELECT page_id, text, {_POS} AS pos FROM ({_template_rows()}) t) u
    WHERE contains(text, 'Book') GROUP BY page_id) v"""))
def node_positions(spark, sf):
    nodes = X.contains_text(X.extract_templates(D.articles(spark, sf)), "Book", "text").where("contains")
    return nodes.groupBy("page_id").agg(F.count("*").alias("n"), F.min("pos").cast("bigint").alias("first_pos"))


@query(f"""SELECT l.page_id, p.page_id AS target_id FROM ({_LINKS}) l JOIN ({_ARTICLES}) p
           ON replace(l.title, 'Topic', 'Page') = p.title""")
def linked_pages(spark, sf):
    pages = D.articles(spark, sf)
    links = X.extract_wikilinks(pages).select(
        "page_id", F.regexp_replace("title", "^Topic ", "page_").alias("target")
    )
    # Loose page names meet under one key, so this is an equality join.
    named = pages.select(F.col("page_id").alias("target_id"), W.page_title_key("title").alias("key"))
    return links.withColumn("key", W.page_title_key("target")).join(named, "key").select("page_id", "target_id")


_NEW_URL = "'https://archive.example.org/' || "


@query(f"""SELECT page_id, length(new_text) AS n_chars, new_text AS content FROM (
             SELECT page_id, replace(replace(content, '[[Topic ', '[[Subject '), ' is about ', ' covers ') || ' (end)' AS new_text
             FROM ({_ARTICLES}) x) y""")
def rewrite_pages(spark, sf):
    pages = R.replace_all(D.articles(spark, sf), [("[[Topic ", "[[Subject "), (" is about ", " covers ")])
    done = R.append_text(pages, " (end)")
    return done.select("page_id", F.length("content").cast("bigint").alias("n_chars"), "content")


@query(f"""SELECT page_id, replace(replace(replace(content, chr(10) || '== References ==', '<br>' || chr(10) || '== References =='),
             '== History ==', '== History ==<!-- h -->'), '; term', '') AS content FROM ({_ARTICLES}) x""")
def rewrite_insert(spark, sf):
    pages = R.insert_before(D.articles(spark, sf), "\n== References ==", "<br>")
    pages = R.insert_after(pages, "== History ==", "<!-- h -->")
    return R.remove_text(pages, "; term").select("page_id", "content")


@query(f"""SELECT page_id, replace(content, '|date=' || regexp_extract(content, '\\|date=([-0-9]+)', 1) || '{'}}'}',
             '|date=2000{'}}'}') AS content FROM ({_ARTICLES}) x""")
def rewrite_page_param(spark, sf):
    done = R.rewrite_page_templates(D.articles(spark, sf), "cite journal", "date", "2000")
    return done.select("page_id", "content")


# --- web pages -----------------------------------------------------------------------------------------------


@query("""SELECT page_id, trim(regexp_extract(t, '<a( [^<>]*)>', 1)) AS attributes,
            regexp_extract(t, '<a [^<>]*>(.*)</a>', 1) AS contents
          FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^<>]*>[^<]*</a>')) AS t FROM pages) q""")
def html_tags(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    return X.extract_tags(pages, "a", "html").select("page_id", "attributes", "contents")


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<br[^<>]*>')) AS BIGINT) AS n FROM pages
          WHERE html LIKE '%<br%'""")
def void_tags(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    return X.extract_tags(pages, "br", "html").groupBy("page_id").agg(F.count_if("self_closing").alias("n"))


@query("""SELECT page_id, 'class' AS name, regexp_extract(t, 'class="([^"]*)"', 1) AS value, '"' AS quotes
          FROM (SELECT page_id, unnest(regexp_extract_all(html, '<div [^<>]*>')) AS t FROM pages) q""")
def tag_attributes(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    found = X.extract_attributes(X.extract_tags(pages, "div", "html"))
    return found.select("page_id", "name", "value", "quotes")


@query("""SELECT page_id, regexp_replace(c, '^<!--|-->$', '', 'g') AS comment
          FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->')) AS c FROM pages) q""")
def html_comments(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    return X.extract_comments(pages, "html").select("page_id", "comment")


@query("""SELECT page_id, replace(replace(replace(f, '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS footer
          FROM (SELECT page_id, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS f FROM pages) q""")
def decoded_entities(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    foot = F.regexp_extract("html", r"(?s)<footer>(.*?)</footer>", 1)
    return pages.select("page_id", W.decode_entities(foot).alias("footer"))


@query("""SELECT page_id, 'https://site' || CAST(page_id % 60 AS VARCHAR) || '.com/x?a=1&b=2' AS link FROM pages""")
def links_from_html(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    away = F.concat(
        F.lit('<a class="out" href="https://site'), (F.col("page_id") % 60).cast("string"),
        F.lit('.com/x?a=1&amp;b=2">x</a><a href="file://x/y">f</a>'),
    )
    return X.links_from_html(pages.select("page_id", "url", F.concat("html", away).alias("html"))).select(
        "page_id", "link"
    )


@query("""SELECT page_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id,
            unnest(string_split_regex(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '</?[A-Za-z][^<>]*>')) AS t FROM pages) q
          WHERE trim(t) <> '' GROUP BY page_id""")
def text_pieces(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.regexp_replace("html", "[\\[\\]'={}]", "").alias("html"))
    return X.extract_text(pages, "html").groupBy("page_id").agg(F.count("*").alias("n"))
