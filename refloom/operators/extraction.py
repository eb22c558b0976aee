"""Wikitext nodes as rows: one function per kind, all map-only over a table with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions import wikitext as W
from refloom.functions.core import let, matches
from refloom.operators.citations import spans_with_sections


def _explode(df: DataFrame, content: str, items: Column) -> DataFrame:
    """Rows of an array of structs, with the position in the page as `pos` (from 1).

    A column of the page with the name of an item field is kept as `page_<name>`.
    """
    keep = [c for c in df.columns if c != content]
    rows = df.select(*keep, F.posexplode(items).alias("_p", "_item"))
    taken = {"pos", *rows.schema["_item"].dataType.fieldNames()}
    return rows.select(
        *[F.col(c).alias(f"page_{c}" if c in taken else c) for c in keep], (F.col("_p") + 1).alias("pos"), "_item.*"
    )


def extract_templates(pages: DataFrame, content: str = "content", outermost: bool = False) -> DataFrame:
    """All closed templates with depth and ancestors, outer before nested; or only those not inside another."""
    spans = B.template_spans(content)
    return _explode(pages, content, B.outermost(spans) if outermost else B.with_ancestors(spans))


def extract_arguments(pages: DataFrame, content: str = "content") -> DataFrame:
    """`{{{name|default}}}` with name and default."""
    items = F.transform(
        B.argument_spans(content),
        lambda s: let(
            F.substring(s["text"], F.lit(4), F.length(s["text"]) - 6),
            lambda body: F.struct(
                s["start"].alias("start"),
                F.trim(F.substring_index(body, "|", 1)).alias("name"),
                F.when(F.contains(body, F.lit("|")), F.regexp_extract(body, r"(?s)^[^|]*\|(.*)$", 1)).alias("default"),
            ),
        ),
    )
    return _explode(pages, content, items)


def extract_wikilinks(pages: DataFrame, content: str = "content") -> DataFrame:
    return _explode(pages, content, W.wikilinks(content))


def extract_external_links(pages: DataFrame, content: str = "content") -> DataFrame:
    return _explode(pages, content, W.external_links(content))


def extract_headings(pages: DataFrame, content: str = "content") -> DataFrame:
    return _explode(pages, content, W.headings(content))


def extract_tags(pages: DataFrame, tag: str, content: str = "content") -> DataFrame:
    return _explode(pages, content, W.tags(content, tag))


def extract_attributes(tags: DataFrame, attributes: str = "attributes") -> DataFrame:
    """One row per attribute of a tag."""
    return _explode(tags.withColumnRenamed("pos", "tag_pos"), attributes, W.tag_attributes(attributes))


def extract_comments(pages: DataFrame, content: str = "content") -> DataFrame:
    return _explode(pages, content, F.transform(W.comments(content), lambda c: F.struct(c.alias("comment"))))


def extract_list_items(pages: DataFrame, content: str = "content") -> DataFrame:
    return _explode(pages, content, W.list_items(content))


def extract_tables(pages: DataFrame, content: str = "content") -> DataFrame:
    return _explode(pages, content, W.tables(content))


def extract_text(pages: DataFrame, content: str = "content") -> DataFrame:
    """Text between the markup: pieces left when templates, links, tags, comments and headings are cut out."""
    marks = (
        r"(?s)<!--.*?-->|</?[A-Za-z][^<>]*>|\[\[[^\[\]]*\]\]|\[[a-z]+:[^\[\]\n]*\]|'{2,}|(?m)^={1,6}[^\n]+?={1,6}[ \t]*$"
    )
    no_templates = _cut_spans(F.col(content))
    parts = F.filter(F.split(no_templates, marks, -1), lambda t: F.trim(t) != "")
    return _explode(pages, content, F.transform(parts, lambda t: F.struct(t.alias("text"))))


def _cut_spans(text: Column) -> Column:
    """Text with every outermost template and argument replaced by an empty comment."""
    spans = B.outermost(B.brace_spans(text))

    def cut(found: Column) -> Column:
        gaps = F.transform(
            F.sequence(F.lit(0), F.size(found)),
            lambda i: F.substring(
                text,
                F.when(i == 0, 0).otherwise(F.get(found, i - 1)["end"]) + 1,
                F.when(i == F.size(found), F.length(text)).otherwise(F.get(found, i)["start"])
                - F.when(i == 0, 0).otherwise(F.get(found, i - 1)["end"]),
            ),
        )
        return F.array_join(gaps, "<!---->")

    return let(spans, cut)


def all_nodes(pages: DataFrame, content: str = "content", tag_names: tuple[str, ...] = ("ref",)) -> DataFrame:
    """Nodes of all kinds in one relation (kind, pos, raw, name): input of `filter_nodes`."""
    null = F.lit(None).cast("string")

    def node(kind: str, raw: Column, name: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), (name if name is not None else null).alias("name"))

    parts = [
        F.transform(B.brace_spans(content), lambda s: F.struct(
            s["kind"].alias("kind"), s["text"].alias("raw"), W.template_name(s["text"]).alias("name"))),
        F.transform(W.wikilinks(content), lambda s: node(
            "wikilink", F.concat(F.lit("[["), F.concat_ws("|", s["title"], s["text"]), F.lit("]]")), s["title"])),
        F.transform(W.external_links(content), lambda s: node("external_link", s["url"], s["title"])),
        F.transform(W.headings(content), lambda s: node("heading", s["title"], s["level"].cast("string"))),
        F.transform(W.comments(content), lambda s: node("comment", s)),
    ]
    parts += [F.transform(W.tags(content, t), lambda s: node("tag", s["contents"], s["tag"])) for t in tag_names]
    return _explode(pages, content, F.concat(*parts))


def filter_nodes(
    nodes: DataFrame,
    kind: str | None = None,
    pattern: str | None = None,
    flags: str = "is",
    column: str = "raw",
) -> DataFrame:
    """Nodes of a kind whose text matches a pattern, by default ignoring case and letting `.` match line ends."""
    out = nodes if kind is None else nodes.where(F.col("kind") == kind)
    if pattern is not None:
        out = out.where(matches(F.col(column), f"(?{flags}){pattern}" if flags else pattern))
    return out


def parents(templates: DataFrame) -> DataFrame:
    """Direct parent of every template of `extract_templates` (start of the parent, null at the top)."""
    return templates.withColumn("parent_start", F.try_element_at("ancestors", F.lit(-1)))


def ancestors(templates: DataFrame) -> DataFrame:
    """One row per template and ancestor, shallow to deep."""
    keep = [c for c in templates.columns if c != "ancestors"]
    return templates.select(*keep, F.posexplode("ancestors").alias("_d", "ancestor_start")).select(
        *keep, (F.col("_d") + 1).alias("ancestor_depth"), "ancestor_start"
    )


def contains_text(nodes: DataFrame, text: str | Column, column: str = "raw") -> DataFrame:
    needle = F.lit(text) if isinstance(text, str) else text
    return nodes.withColumn("contains", F.coalesce(F.contains(F.col(column), needle), F.lit(False)))


def with_params(templates: DataFrame, text: str = "text") -> DataFrame:
    """Name and parameter list of a template text."""
    return templates.withColumns({"name": W.template_name(text), "params": W.template_params(text)})


def explode_params(templates: DataFrame, params: str = "params") -> DataFrame:
    keep = [c for c in templates.columns if c != params]
    return templates.select(*keep, F.explode(params).alias("_p")).select(
        *keep,
        F.col("_p.pos").alias("param_pos"),
        F.col("_p.name").alias("param"),
        F.col("_p.value").alias("value"),
    )


def section_of(pages: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    """Every template with the heading in force at its position."""
    items = spans_with_sections(B.template_spans(content), W.headings(content), strict)
    return _explode(pages, content, items)


def sections(
    pages: DataFrame,
    content: str = "content",
    levels: list[int] | None = None,
    matching: str | None = None,
    flat: bool = False,
    include_lead: bool | None = None,
    include_headings: bool = True,
) -> DataFrame:
    """Sections of a page: level, title, text. A section holds its subsections unless `flat`.

    The lead (level 0) is added when asked for, or when neither levels nor a pattern is given.
    """
    lead = include_lead if include_lead is not None else (levels is None and matching is None)
    text = F.col(content)

    def cut(heads: Column) -> Column:
        length = F.length(text)

        def one(h: Column, i: Column) -> Column:
            after = F.slice(heads, i + 2, F.greatest(F.size(heads) - i - 1, F.lit(0)))
            closing = after if flat else F.filter(after, lambda o: o["level"] <= h["level"])
            end = F.coalesce(F.try_element_at(closing, F.lit(1))["start"], length)
            start = h["start"] if include_headings else h["end"]
            return F.struct(
                h["start"].alias("start"),
                h["level"].alias("level"),
                F.trim(h["title"]).alias("title"),
                F.substring(text, start + 1, end - start).alias("text"),
            )

        out = F.transform(heads, one)
        if levels is not None:
            out = F.filter(out, lambda s: s["level"].isin(*levels))
        if matching is not None:
            out = F.filter(out, lambda s: matches(s["title"], f"(?is){matching}"))
        if lead:
            first = F.coalesce(F.try_element_at(heads, F.lit(1))["start"], length)
            lead_row = F.struct(
                F.lit(-1).alias("start"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("title"),
                F.substring(text, F.lit(1), first).alias("text"),
            )
            out = F.concat(F.array(lead_row), out)
        return out

    return _explode(pages, content, let(W.headings(content), cut))


def plain_text(pages: DataFrame, content: str = "content", **options) -> DataFrame:
    return pages.withColumn("plain", W.strip_code(content, **options))


def links_from_html(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Absolute links of a web page that lead away from it, blanks collapsed; one row per link."""
    hrefs = F.regexp_extract_all(
        F.col(html), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1)
    )
    own = F.regexp_extract(F.col(url), r"^([a-z]+://[^/]+)", 1)
    kept = F.filter(
        hrefs,
        lambda h: F.contains(h, F.lit("://")) & ~h.startswith(own) & ~h.startswith("file"),
    )
    cleaned = F.transform(
        kept, lambda h: F.struct(F.trim(F.regexp_replace(W.decode_entities(h), r"\s+", " ")).alias("link"))
    )
    return _explode(pages, html, cleaned)
