"""Quality report on citations: unknown and repeated parameters, bad identifiers, dates, addresses."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import citation as C
from refloom.functions import identifiers as I
from refloom.functions.core import in_list, is_set, let, matches, settle
from refloom.functions.dates import acceptable_date, is_date, parse_date, valid_access_date, year_date_mismatch
from refloom.functions.fields import any_invisible, extra_page_text, invisible_chars, valid_keyword
from refloom.functions.given import alias_groups, given_parts
from refloom.functions.names import author_source, has_et_al
from refloom.functions.urls import has_external_link, link_param_ok, valid_url
from refloom.tables.params import (
    DEPRECATED,
    FIELD_ALIASES,
    ID_KINDS,
    KEYWORD_PARAMS,
    KNOWN_PARAMS,
    NAME_LISTS,
    NUMBERED_PARAMS,
)

_FIELD_NO = {name: i for i, name in enumerate(FIELD_ALIASES)}


def param_status(name: Column, value: Column) -> Column:
    """`known`, `deprecated`, `suggest` (the lower-case name is known), `text` (unnamed) or `unknown`."""
    numbered = F.regexp_replace(name, r"\d+", "#")

    def supported(n: Column, general: Column) -> Column:
        return in_list(n, KNOWN_PARAMS) | in_list(general, NUMBERED_PARAMS)

    return (
        F.when(in_list(name, DEPRECATED), "deprecated")
        .when(supported(name, numbered), "known")
        .when(matches(name, r"^\d+$"), F.when(is_set(F.trim(value)), "text").otherwise("known"))
        .when(supported(F.lower(name), F.lower(numbered)), "suggest")
        .otherwise("unknown")
    )


def unknown_params(df: DataFrame, params: str = "params") -> DataFrame:
    """One row per parameter that is not plainly supported, with status and suggestion.

    The list of supported names is part of the expression, so nothing is joined.
    """
    keep = [c for c in df.columns if c != params]
    rows = df.select(*keep, F.explode(params).alias("param", "value")).where(F.col("value") != "")
    status = param_status(F.col("param"), F.col("value"))
    return (
        rows.withColumn("status", status)
        .where(F.col("status") != "known")
        .withColumn("suggestion", F.when(F.col("status") == "suggest", F.lower("param")))
    )


def _one_field_twice(params: Column) -> Column:
    """Some field is set by two parameters or more: each name leads to the numbers of its fields, one of which comes again."""
    fields = list(alias_groups().values())
    shared = sorted({n for names in fields for n in names})
    table = F.array(*[F.lit(n) for n in shared])
    numbers = F.array(*[F.array(*[F.lit(i) for i, names in enumerate(fields) if n in names]) for n in shared])
    given = F.filter(F.map_keys(params), lambda k: k.isin(*shared))
    met = F.flatten(F.transform(given, lambda k: F.get(numbers, F.array_position(table, k).cast("int") - 1)))
    return let(met, lambda ns: F.size(F.array_distinct(ns)) < F.size(ns))


def redundant_params(df: DataFrame, params: str = "params") -> DataFrame:
    """One row per field that is set by more than one parameter: the one used and the others."""
    keep = [c for c in df.columns if c != params]
    fields = alias_groups()
    # A row sets few of the names: they are picked by one hash probe each, and only these are sought per field.
    shared = sorted({n for names in fields.values() for n in names})
    given = F.filter(
        F.map_entries(F.col(params)), lambda e: is_set(e["value"]) & e["key"].isin(*shared)
    )
    table = F.array(
        *[F.struct(F.lit(f).alias("field"), F.array(*[F.lit(n) for n in names]).alias("names")) for f, names in fields.items()]
    )

    def check(names: Column) -> Column:
        listed = F.transform(
            table,
            lambda t: F.struct(
                t["field"].alias("field"), F.filter(t["names"], lambda n: F.array_contains(names, n)).alias("used")
            ),
        )
        found = F.filter(listed, lambda e: F.size(e["used"]) > 1)
        return F.when(F.size(names) > 1, found)

    # Through a generator, as an explode brings a filter along that would compute the fields a second time.
    used = let(F.transform(given, lambda e: e["key"]), check)
    df = settle(df.select(*keep, used.alias("_used")), ["_used"])
    return df.select(*keep, F.explode("_used").alias("_f")).select(
        *keep,
        F.col("_f.field").alias("field"),
        F.element_at("_f.used", 1).alias("chosen"),
        F.expr("slice(_f.used, 2, size(_f.used) - 1)").alias("ignored"),
    )


def invisible_report(df: DataFrame, params: str = "params") -> DataFrame:
    """One row per parameter, character group and position of the first hit."""
    keep = [c for c in df.columns if c != params]
    rows = df.select(*keep, F.explode(params).alias("param", "value"))
    return rows.select(*keep, "param", F.explode(invisible_chars("value")).alias("_h")).select(
        *keep, "param", F.col("_h.group").alias("group"), F.col("_h.position").alias("position")
    )


def name_list(params: Column, kind: str) -> Column:
    """What the numbered people of one kind amount to, whatever their number.

    Numbers are walked from 1 (a bare name is number 1) until two of them have no name, with no last name between. `lasts`: last names met;
    `names`: first and last names met; `links`: links of those with a last name; `first_alone`: a first name without a
    last name was met; `hole`: a last name came after a number without any name.
    """
    parts = {part: [n.replace("#", "") for n in names] for part, names in NAME_LISTS[kind].items() if part != "mask"}
    every = sorted({n for names in parts.values() for n in names})

    def read(entries: Column) -> Column:
        def at(part: str, i: Column) -> Column:
            return F.get(F.filter(entries, lambda e: (e["no"] == i) & e["name"].isin(*parts[part])), F.lit(0))["value"]

        texts = F.array().cast("array<string>")
        start = F.struct(
            texts.alias("lasts"), texts.alias("names"), texts.alias("links"), F.lit(False).alias("first_alone"),
            F.lit(False).alias("hole"), F.lit(0).alias("missing"),
        )

        def step(acc: Column, i: Column) -> Column:
            def use(x: Column) -> Column:
                last, first, link = x["last"], x["first"], x["link"]
                found = last.isNotNull()
                missing = F.when(found, 0).when(first.isNotNull(), acc["missing"]).otherwise(acc["missing"] + 1)
                return F.when(acc["missing"] >= 2, acc).otherwise(
                    F.struct(
                        F.array_compact(F.concat(acc["lasts"], F.array(last))).alias("lasts"),
                        F.array_compact(F.concat(acc["names"], F.array(last, first))).alias("names"),
                        F.array_compact(F.concat(acc["links"], F.array(F.when(found, link)))).alias("links"),
                        (acc["first_alone"] | (first.isNotNull() & ~found)).alias("first_alone"),
                        (acc["hole"] | (found & (acc["missing"] == 1))).alias("hole"),
                        missing.alias("missing"),
                    )
                )

            return let(F.struct(*[at(k, i).alias(k) for k in ("last", "first", "link")]), use)

        # No more numbers than this can be met before two are missing.
        numbers = F.sequence(F.lit(1), 2 * F.size(entries) + 2)
        return F.when(F.size(entries) > 0, F.aggregate(numbers, start, step)).otherwise(start)

    def entry(e: Column) -> Column:
        number = F.regexp_extract(e["key"], r"(\d+)", 1)
        return F.struct(
            F.regexp_replace(e["key"], r"\d+", "").alias("name"),
            F.coalesce(F.when(number == "", F.lit(1)).otherwise(number.try_cast("int")), F.lit(0)).alias("no"),
            e["value"].alias("value"),
        )

    listed = F.filter(F.transform(F.map_entries(params), entry), lambda e: e["name"].isin(*every))
    return let(listed, read)


def error_kinds(cls: str = "cls", as_of_year: int = 2026, as_of_date: str = "2026-01-01") -> Column:
    """`array<string>` of the error and maintenance kinds of one citation.

    Reads `_given` (set parameters), `_status` (kind of each), `_values` (fields), `_twice` (a field is set twice), `_list_<kind>` and `_ids`, which `with_errors` adds.
    """
    m = F.col("_given")
    a = lambda f: F.get("_values", F.lit(_FIELD_NO[f]))
    c = F.col(cls)

    def value(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names])

    def has_status(status: str) -> Column:
        return F.array_contains("_status", status)

    def bad(check, field_value: Column) -> Column:
        return let(field_value, lambda v: v.isNotNull() & ~check(v))

    def id_value(kind: str) -> Column:
        return F.try_element_at("_ids", F.lit(kind))

    def date_bad(v: Column) -> Column:
        return let(v, lambda d: d.isNotNull() & ~acceptable_date(d, as_of_year))

    def other_date_bad(v: Column) -> Column:
        return let(v, lambda d: d.isNotNull() & ~F.coalesce(is_date(d, as_of_year), F.lit(False)))

    def other_date_open(v: Column) -> Column:
        """A date of any day, past or to come."""
        return let(v, lambda d: d.isNotNull() & ~F.coalesce(is_date(d, as_of_year + 100), F.lit(False)))

    def year_bad(v: Column) -> Column:
        # Only a year may be a rough one.
        return let(v, lambda d: d.isNotNull() & ~matches(d, r"^c\. [1-9]\d{2,3}[a-z]?$") & other_date_bad(d))

    # The first of these is the date; the others are judged on their own where it is not they.
    dated, yeared = F.coalesce(a("Date"), a("AirDate")), F.coalesce(a("Date"), a("AirDate"), a("Year"))

    def shown_bad(v: Column) -> Column:
        """How many names to show: neither a number nor some spelling of et al."""
        return let(v, lambda x: x.isNotNull() & ~matches(x, r"^\d+$") & (F.regexp_replace(F.lower(x), r"[ '.]", "") != "etal"))

    lists = [F.col(f"_list_{kind}") for kind in NAME_LISTS]

    def any_list(test) -> Column:
        return functools.reduce(operator.or_, [test(x) for x in lists])

    has_contributor = F.size("_list_contributor.lasts") > 0
    keyword_bad = F.lit(False)
    for name in KEYWORD_PARAMS:
        spelled = [name, name.replace("-", "")] if "-" in name else [name, "no-pp"] if name == "nopp" else [name]
        keyword_bad = keyword_bad | ~valid_keyword(value(*spelled), name)
    title_set = F.coalesce(a("Title"), a("TransTitle"), a("ScriptTitle")).isNotNull()
    # An encyclopedia citation takes the name of the work as title.
    has_title = title_set | ((c == "encyclopaedia") & a("Periodical").isNotNull()) | (
        (c == "conference") & a("BookTitle").isNotNull()
    )
    has_title = F.when(c == "episode", a("Series").isNotNull()).otherwise(has_title)
    url, chapter_url = a("URL"), a("ChapterURL")
    access = a("AccessDate")
    access_kept = F.when(c.isin("nrisref", "gnis", "policy", "season", "sports-reference", "nhle", "england"), access)
    names_source = author_source(m)
    any_author = (F.size("_list_author.lasts") > 0) | value("authors", "vauthors").isNotNull()
    vanc = F.try_element_at(m, F.lit("vauthors"))
    n_authors = F.when(F.size("_list_author.lasts") > 0, F.size("_list_author.lasts")).otherwise(F.size(F.split(vanc, ",")))
    bad_vanc = F.exists(
        F.split(vanc, r"\s*,\s*"),
        lambda n: ~matches(n, r"^\(\(.+\)\)$") & matches(n, r"\s") & ~matches(n, r"\s[A-Z]{1,2}$"),
    )
    arxiv_only = (
        F.coalesce(access, a("At"), a("Chapter"), a("Format"), a("Page"), a("Pages"), a("Periodical"),
                   a("PublisherName"), url).isNotNull()
        | (F.size(F.map_filter("_ids", lambda k, _: k != "ARXIV")) > 0)
    )
    page_like = F.coalesce(a("Page"), a("Pages"))
    isbn = id_value("ISBN")
    mismatch = let(
        F.struct(a("Year").alias("y"), a("Date").alias("d")),
        lambda s: F.when(s["y"].isNotNull() & s["d"].isNotNull(), year_date_mismatch(s["y"], s["d"])),
    )

    checks: dict[str, Column] = {
        "accessdate_missing_url": access.isNotNull() & F.coalesce(url, chapter_url).isNull(),
        "archive_missing_date": a("ArchiveURL").isNotNull() & a("ArchiveDate").isNull(),
        "archive_missing_url": a("ArchiveURL").isNotNull() & F.coalesce(url, chapter_url).isNull(),
        "arxiv_missing": (c == "arxiv") & id_value("ARXIV").isNull(),
        "arxiv_params_not_supported": (c == "arxiv") & arxiv_only,
        "bad_arxiv": bad(I.valid_arxiv, id_value("ARXIV")),
        "bad_asin": bad(I.valid_asin, id_value("ASIN")),
        "bad_date": date_bad(C.date_promotion(a("Date"), a("Year"), a("PublicationDate"), a("AirDate")))
        | other_date_bad(a("ArchiveDate"))
        | other_date_bad(a("LayDate"))
        | other_date_bad(a("DoiBroken"))
        | other_date_open(a("Embargo"))
        | (dated.isNotNull() & year_bad(a("Year")))
        | (yeared.isNotNull() & other_date_bad(a("PublicationDate")))
        | let(
            access_kept,
            lambda d: d.isNotNull()
            & ~F.coalesce(
                valid_access_date(parse_date(d, as_of_year)["start"], F.lit(as_of_date).cast("date")), F.lit(False)
            ),
        ),
        "bad_doi": bad(I.valid_doi, id_value("DOI")),
        "bad_isbn": bad(I.valid_isbn, isbn) & ~in_list(F.lower(a("IgnoreISBN")), ["yes", "true", "y"]),
        "bad_ismn": bad(I.valid_ismn, id_value("ISMN")),
        "bad_issn": bad(I.valid_issn, id_value("ISSN")),
        "bad_lccn": bad(I.valid_lccn, id_value("LCCN")),
        "bad_message_id": bad(I.valid_message_id, id_value("USENETID")),
        "bad_ol": bad(I.valid_ol, id_value("OL")),
        "bad_paramlink": F.exists(
            F.concat(F.array(a("TitleLink"), a("SeriesLink")), *[x["links"] for x in lists]),
            lambda v: v.isNotNull() & ~link_param_ok(v),
        ),
        "bad_pmc": bad(I.valid_pmc, id_value("PMC")),
        "bad_pmid": bad(I.valid_pmid, id_value("PMID")),
        "bad_url": F.exists(
            F.array(url, chapter_url, a("ArchiveURL"), a("ConferenceURL"), a("LayURL"), a("TranscriptURL"), a("MapURL")),
            lambda v: v.isNotNull() & ~valid_url(v),
        ),
        "bare_url_missing_title": url.isNotNull() & ~title_set & a("Chapter").isNull(),
        "chapter_ignored": c.isin("web", "news", "journal", "magazine", "pressrelease", "podcast", "newsgroup")
        & F.coalesce(a("Chapter"), a("TransChapter"), chapter_url).isNotNull(),
        "citation_missing_title": ~F.coalesce(has_title, F.lit(False)),
        "cite_web_url": c.isin("web", "podcast", "mailinglist") & url.isNull(),
        "coauthors_missing_author": a("Coauthors").isNotNull() & ~any_author,
        "contributor_ignored": has_contributor
        & (~c.isin("book", "citation") | a("Periodical").isNotNull()),
        "contributor_missing_required_param": has_contributor
        & c.isin("book", "citation")
        & a("Periodical").isNull()
        & (a("Contribution").isNull() | ~any_author),
        "deprecated_params": value(*DEPRECATED).isNotNull(),
        "empty_citation": F.size(m) == 0,
        "first_missing_last": any_list(lambda x: x["first_alone"]),
        "format_missing_url": (a("Format").isNotNull() & url.isNull())
        | (a("ChapterFormat").isNotNull() & chapter_url.isNull()),
        "implict_etal_editor": in_list(F.lower(a("DisplayEditors")), ["etal", "et al", "et al."]),
        "invalid_param_val": keyword_bad | shown_bad(a("DisplayAuthors")) | shown_bad(a("DisplayEditors")),
        "invisible_char": any_invisible(F.array_join(F.map_values(m), "")),
        "missing_name": any_list(lambda x: x["hole"]),
        "param_has_ext_link": F.exists(
            F.array(a("Title"), a("Chapter"), a("Periodical"), a("PublisherName")),
            lambda v: v.isNotNull() & has_external_link(v),
        ),
        "parameter_ignored": has_status("unknown"),
        "parameter_ignored_suggest": has_status("suggest"),
        "redundant_parameters": F.col("_twice"),
        "text_ignored": has_status("text"),
        "trans_missing_title": (a("TransTitle").isNotNull() & a("Title").isNull())
        | (a("TransChapter").isNotNull() & F.coalesce(a("Chapter"), a("Title")).isNull()),
        "vancouver": (names_source == "vancouver") & bad_vanc,
        "wikilink_in_url": F.exists(F.array(url, chapter_url), lambda v: F.contains(v, F.lit("[["))),
        "maint_date_year": F.coalesce(mismatch == 1, F.lit(False)),
        "date_mismatch": F.coalesce(mismatch == 0, F.lit(False)),
        "maint_asin_isbn": matches(id_value("ASIN"), r"^\d{9}[\dX]$") & I.valid_isbn(id_value("ASIN")),
        "maint_etal": any_list(lambda x: F.exists(x["names"], has_et_al)),
        "maint_extra_text": F.coalesce(extra_page_text(page_like), F.lit(False)),
        "maint_disp_auth_ed": F.coalesce(a("DisplayAuthors").try_cast("int") >= n_authors, F.lit(False)),
        "maint_embargo": let(
            a("Embargo"),
            lambda d: d.isNotNull() & (parse_date(d, as_of_year + 100)["start"] < F.lit(as_of_date).cast("date")),
        ),
        "maint_extra_text_edition": matches(a("Edition"), r"(?<![A-Za-z])(?:[Ee]d\.?|[Ee]dition)$"),
        "maint_untitled": (a("Title") == "none")
        & c.isin("journal", "citation")
        & (C.alias_origin("_given", "Periodical") == "journal"),
        "maint_english": F.lower(a("Language")).isin("en", "english"),
    }
    # Leaves out the nulls; `array_compact` is a lambda, whose whole argument Spark interprets.
    return F.array_except(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(kind)) for kind, cond in checks.items()]),
        F.array(F.lit(None).cast("string")),
    )


def with_errors(parsed: DataFrame, as_of_year: int = 2026, as_of_date: str = "2026-01-01") -> DataFrame:
    """Add `errors` to the output of `parse_templates`."""
    staged = (
        parsed.withColumn("_given", C.set_params("params"))
        .withColumn("_parts", given_parts("params", _FIELD_NO, checks=True))
        .withColumns({"_status": F.col("_parts.status"), "_values": F.col("_parts.values"), "_ids": F.col("_parts.ids"), "_twice": F.col("_parts.twice")})
        .withColumns({f"_list_{kind}": F.col(f"_parts.list_{kind}") for kind in NAME_LISTS})
        .drop("_parts")
    )
    found = staged.withColumn("errors", error_kinds(as_of_year=as_of_year, as_of_date=as_of_date))
    # Without this the filter that an explode brings along would copy the whole expression, field by field.
    made = ["_given", "_status", "_values", "_ids", "_twice", *[f"_list_{kind}" for kind in NAME_LISTS]]
    return settle(found.drop(*made), ["errors"])


def quality_report(parsed: DataFrame, **options) -> DataFrame:
    """Citations per error kind; the kinds are few, so partial counts make the shuffle tiny."""
    return (
        with_errors(parsed, **options)
        .select(F.explode("errors").alias("kind"))
        .groupBy("kind")
        .agg(F.count("*").alias("n"))
    )
