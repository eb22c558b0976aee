"""Bulk edits of wikitext."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions import wikitext as W
from refloom.functions.core import let, scan


def replace_all(pages: DataFrame, rules: list[tuple[str, str]], content: str = "content") -> DataFrame:
    """Replace texts everywhere, rules in order; an empty replacement removes. The rules travel inside the plan."""
    table = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in rules])
    edited = F.aggregate(table, F.col(content), lambda acc, r: F.replace(acc, r["old"], r["new"]))
    return pages.withColumn(content, edited)


def remove_text(pages: DataFrame, text: str, content: str = "content") -> DataFrame:
    return replace_all(pages, [(text, "")], content)


def insert_before(pages: DataFrame, anchor: str, text: str, content: str = "content") -> DataFrame:
    return replace_all(pages, [(anchor, text + anchor)], content)


def insert_after(pages: DataFrame, anchor: str, text: str, content: str = "content") -> DataFrame:
    return replace_all(pages, [(anchor, anchor + text)], content)


def append_text(pages: DataFrame, text: str | Column, content: str = "content") -> DataFrame:
    return pages.withColumn(content, F.concat(F.col(content), F.lit(text) if isinstance(text, str) else text))


def rewrite_param(
    templates: DataFrame, name: str, value: Column | None, text: str = "text", only_name: str | None = None
) -> DataFrame:
    """Set one parameter of every template (or remove it with `value=None`); other templates stay as they are."""

    def edited(t: Column) -> Column:
        params = W.template_params(t)
        changed = W.drop_param(params, name) if value is None else W.set_param(params, name, value)
        return W.template_text(W.template_name(t), changed)

    c = F.col(text)
    new = let(c, edited)
    if only_name is not None:
        new = F.when(W.template_name(c) == only_name, new).otherwise(c)
    return templates.withColumn(text, new)


def rewrite_page_templates(
    pages: DataFrame, template: str, name: str, value: str | None, content: str = "content"
) -> DataFrame:
    """Set or remove one parameter in every outermost template of that name on a page.

    The page is put together anew from the spans and the text between them, so the same text elsewhere, as in a comment
    or a `nowiki` tag, stays as it is.
    """
    page = F.col(content)

    def edited(t: Column) -> Column:
        params = W.template_params(t)
        changed = W.drop_param(params, name) if value is None else W.set_param(params, name, F.lit(value))
        wanted = F.lower(W.template_name(t)) == template.lower()
        return F.when(wanted, W.template_text(W.template_name(t), changed)).otherwise(t)

    def step(at: Column, s: Column) -> Column:
        piece = F.concat(F.substr(page, at + 1, s["start"] - at), edited(s["text"]))
        return F.struct(s["end"].alias("state"), F.array(piece).alias("out"))

    def edit(spans: Column) -> Column:
        end = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(scan(spans, F.lit(0), step, "string"), ""), F.substr(page, end + 1))

    return pages.withColumn(content, let(B.outermost(B.template_spans(content)), edit))
