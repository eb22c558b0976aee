"""Citations out of articles, and their normalised form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions import citation as C
from refloom.functions import wikitext as W
from refloom.functions.core import cut_runs, first_set, is_set, let, settle, unfused
from refloom.functions.dates import approx_or_no_date, parse_date
from refloom.functions.fields import clean_pages, coins_title, hyphen_to_dash
from refloom.functions.given import given_parts
from refloom.functions.names import people_text
from refloom.functions.reader import read_template
from refloom.tables.markup import INITIAL_SECTION
from refloom.tables.templates import CITATION_TYPES, NOT_PARSABLE, TEMPLATE_NAMES

# Year that stands for "now" in date checks; a parameter so that results can be repeated.
AS_OF_YEAR = 2026

TEXT_FIELDS = (
    "Degree City SeriesNumber AccessDate Chapter PublisherName Format Title URL Series Encyclopedia Periodical"
    " PublicationPlace Date Edition Pages Chron Issue Volume TitleType"
).split()
FIELDS = (
    "Degree City SeriesNumber AccessDate Chapter PublisherName Format Title URL Series Authors ID_list Encyclopedia"
    " Periodical PublicationPlace Date Edition Pages Chron Issue Volume TitleType"
).split()

#: Fields that labelling and look-up read.
MINIMAL_FIELDS = ["Title", "URL", "Authors", "ID_list"]

# What each field is made of: working columns (lower case) and parameters (as they are called in the table of aliases).
_ARXIV = "ids access_date chapter fmt page_text publisher url periodical"
_READS = {
    "Degree": "degree",
    "City": "city",
    "SeriesNumber": "series_number",
    "AccessDate": "access_date",
    "Chapter": "chapter title script_chapter periodical periodical_origin encyclopedia",
    "PublisherName": "publisher",
    "Format": "fmt",
    "Title": "title chapter script_title periodical periodical_origin encyclopedia",
    "URL": "url chapter_url ids embargo",
    "Series": "series",
    "Encyclopedia": "encyclopedia",
    "Periodical": "periodical",
    "PublicationPlace": "place",
    "Date": "date_text",
    "Edition": "edition",
    "Pages": "page_text",
    "Chron": "date_text",
    "Issue": "issue",
    "Volume": "volume",
    "TitleType": "type_given others degree",
    "Authors": "with_contributors",
    "ID_list": "ids",
    # Working columns, with the remaps of classes that write them.
    "title": "Title script_title chapter periodical encyclopedia book_title series",
    "script_title": "ScriptTitle title chapter periodical encyclopedia",
    "title_link": "TitleLink",
    "chapter": "Chapter Map Episode title script_title title_link encyclopedia book_title " + _ARXIV,
    "script_chapter": "ScriptChapter script_title chapter title periodical encyclopedia",
    "chapter_url": "ChapterURL MapURL url chapter title script_title periodical encyclopedia book_title",
    "url": "URL title script_title encyclopedia book_title " + _ARXIV,
    "fmt": "Format title script_title encyclopedia book_title " + _ARXIV,
    "periodical": "Periodical MailingList periodical_origin title script_title chapter encyclopedia",
    "periodical_origin": "Periodical",
    "encyclopedia": "Encyclopedia",
    "book_title": "BookTitle",
    "series": "Series Season series_number issue title_link url ids",
    "series_number": "SeriesNumber",
    "publisher": "PublisherName " + _ARXIV,
    "degree": "Degree",
    "edition": "Edition",
    "type_given": "TitleType",
    "others": "Others",
    "embargo": "Embargo",
    "date_text": "Date AirDate Year PublicationDate",
    "place": "PublicationPlace Place",
    "city": "City",
    "access_date": "AccessDate " + _ARXIV,
    "ids": "series",
    "volume": "Volume Periodical",
    "issue": "Issue Periodical",
    "page_text": "Sheet Sheets Page Pages At " + _ARXIV,
    "with_contributors": "Contribution Periodical",
}


def _needed(fields: list[str]) -> tuple[list[str], list[str]]:
    """(working columns that the fields read, parameters that these go back to)."""
    direct = [c for f in fields for c in _READS[f].split()]
    seen, todo = set(), list(direct)
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            # A parameter may have the name of a field (`Title`); only working columns lead further.
            todo += _READS[name].split() if name.islower() else []
    return list(dict.fromkeys(direct)), sorted(n for n in seen if not n.islower())


def spans_with_sections(spans: Column, heads: Column, strict: bool = False) -> Column:
    """Spans as `struct<start,text,section>`: the title of the last heading before each, in the order of the spans.

    Spans and headings are sorted into one list by position and the list is cut at the headings, so a page costs
    n log n in its spans and headings together. `strict` takes only headings written `== Title ==` with two signs and a
    blank; the default takes any heading from level 2.
    """
    usable = F.filter(
        heads, lambda h: ((h["level"] == 2) & h["title"].startswith(" ")) if strict else (h["level"] >= 2)
    )
    marks = F.transform(
        usable,
        lambda h: F.struct(
            h["start"].alias("start"),
            F.lit(1).alias("head"),  # after a span at the same place
            F.trim(F.replace(h["title"], F.lit("=="), F.lit(""))).alias("text"),
        ),
    )
    places = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("head"), s["text"].alias("text"))
    )

    def named(run: Column) -> Column:
        first = F.get(run, F.lit(0))
        title = F.when(first["head"] == 1, first["text"]).otherwise(INITIAL_SECTION)
        return F.transform(
            F.filter(run, lambda x: x["head"] == 0),
            lambda x: F.struct(x["start"].alias("start"), x["text"].alias("text"), title.alias("section")),
        )

    in_order = F.array_sort(F.concat(places, marks))
    return F.flatten(F.transform(cut_runs(in_order, lambda x, _: x["head"] == 1), lambda run: let(run, named)))


def _with_all_sections(rows: Column) -> Column:
    """Add `pos` (from 1) and `sections_all`, the sections of every occurrence of the same text, by one sort by text."""
    numbered = F.transform(
        rows,
        lambda r, i: F.struct(
            r["text"].alias("citations"), (i + 1).alias("pos"), r["start"].alias("start"), r["section"].alias("section")
        ),
    )

    def together(run: Column) -> Column:
        return let(
            F.transform(run, lambda x: x["section"]),
            lambda names: F.transform(
                run,
                lambda x: F.struct(
                    x["pos"].alias("pos"),
                    x["start"].alias("start"),
                    x["citations"].alias("citations"),
                    x["section"].alias("section"),
                    names.alias("sections_all"),
                ),
            ),
        )

    runs = cut_runs(F.array_sort(numbered), lambda x, before: x["citations"] != before["citations"])
    return F.array_sort(F.flatten(F.transform(runs, together)))


def extract_citations(articles: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    """One row per template of an article, outer before nested, with section and type.

    Map-only: templates and headings are found inside the row, at n log n of the page's templates and headings.
    `sections_all` holds the sections of every occurrence of the same text on the page.
    """
    keep = [c for c in articles.columns if c != content]
    found = _with_all_sections(spans_with_sections(B.template_spans(content), W.headings(content), strict))
    rows = articles.select(*keep, F.explode(found).alias("c"))
    return rows.select(*keep, "c.*", C.citation_type(F.col("c.citations"), strict).alias("type_of_citation"))


def filter_known_types(df: DataFrame, column: str = "type_of_citation") -> DataFrame:
    return df.where(F.col(column).isin(*CITATION_TYPES))


def rejected_types(df: DataFrame, column: str = "type_of_citation") -> DataFrame:
    """Distinct types outside the known ones, with their counts."""
    return df.where(~F.col(column).isin(*CITATION_TYPES)).groupBy(column).agg(F.count("*").alias("n"))


def type_names(spark, lang: str | None = None) -> DataFrame:
    """Accepted template names per language as a table."""
    rows = [(code, name) for code, names in TEMPLATE_NAMES.items() for name in names if lang in (None, code)]
    return spark.createDataFrame(rows, "lang string, name string")


def parse_templates(df: DataFrame, citation: str, strict: bool = False, as_of_year: int = AS_OF_YEAR) -> DataFrame:
    """Add `template`, `template_name`, `cls`, `params` (map) and `parse_failed` to rows with a citation text."""
    cls = C.citation_class("template_name", strict)
    read = df.withColumn("_read", read_template(citation))
    staged = (
        read.withColumns({"template": F.col("_read.template"), "template_name": F.col("_read.name"), "_raw": F.col("_read.params")})
        .withColumn("cls", cls)
        .withColumn("params", C.remap_positional("cls", "_raw", as_of_year))
        .withColumn("parse_failed", F.col("template").isNull())
        .drop("_read", "_raw")
    )
    return settle(staged, ["template", "template_name", "cls", "params", "parse_failed"])


def normalize_citations(
    df: DataFrame,
    citation: str = "citation",
    lang: str = "en",
    strict: bool = False,
    as_of_year: int = AS_OF_YEAR,
    as_of_date: str | None = None,
    fields: list[str] | None = None,
) -> DataFrame:
    """Add the 22 fields of the common schema, or those named in `fields`, to rows with a citation text.

    Only the parameters, rules and remaps that the fields go back to (`_READS`) are planned.

    Text fields are never null. `Authors` is an array of people and `ID_list` a map from kind to value; see
    `legacy_text` for their text form. An input column that has the name of a field is kept as `page_<name>`. The
    class-specific rules run one after the other over plain columns, so the whole operator is one map-only stage.
    """
    wanted = [n for n in FIELDS if fields is None or n in fields]
    if fields is not None and len(wanted) != len(set(fields)):
        raise ValueError(f"no such fields: {sorted(set(fields) - set(FIELDS))}")
    working, raw = _needed(wanted)
    place = {name: i for i, name in enumerate(raw)}
    # Input columns travel as one struct, so that none of them can meet a working column of the same name.
    p = parse_templates(
        df.select(F.struct(*df.columns).alias("_in"), F.col(citation).alias("_citation")),
        "_citation",
        strict,
        as_of_year,
    )
    parsed = p.columns
    known = C.is_citation_template("template_name", lang, strict)
    null = F.lit(None).cast("string")
    a = lambda field: F.get("_given.values", F.lit(place[field])) if field in place else null

    p = p.withColumn("_given", given_parts("params", raw, people="Authors" in wanted))
    p = p.withColumns(
        {
            "known": unfused(F.coalesce(known, F.lit(False))),
            "title": a("Title"),
            "script_title": a("ScriptTitle"),
            "title_link": a("TitleLink"),
            "chapter": a("Chapter"),
            "script_chapter": a("ScriptChapter"),
            "chapter_url": a("ChapterURL"),
            "url": a("URL"),
            "periodical": a("Periodical"),
            "periodical_origin": C.alias_origin("params", "Periodical"),
            "encyclopedia": a("Encyclopedia"),
            "book_title": a("BookTitle"),
            "fmt": a("Format"),
            "series": a("Series"),
            "season": a("Season"),
            "series_number": a("SeriesNumber"),
            "publisher": a("PublisherName"),
            "degree": a("Degree"),
            "edition": a("Edition"),
            "type_given": a("TitleType"),
            "others": a("Others"),
            "contribution": a("Contribution"),
            "embargo": a("Embargo"),
            "date_text": F.coalesce(a("Date"), a("AirDate"), a("Year"), a("PublicationDate")),
            "place": F.coalesce(a("PublicationPlace"), a("Place")),
            "city": a("City"),
            "access_date": C.access_date_rule("cls", a("AccessDate")),
            "ids": F.col("_given.ids"),
        }
    )
    p = p.withColumns(
        {
            "volume": C.volume_rule("cls", a("Volume"), "periodical"),
            "issue": C.issue_rule("cls", a("Issue"), "periodical"),
            "page_text": F.coalesce(
                a("Sheet"),
                a("Sheets"),
                C.page_rule("cls", a("Page")),
                C.page_rule("cls", hyphen_to_dash(a("Pages"))),
                C.page_rule("cls", a("At")),
            ),
            "with_contributors": F.col("cls").isin("book", "citation")
            & F.col("periodical").isNull()
            & F.col("contribution").isNotNull(),
        }
    )
    p = _class_remaps(_encyclopedia_remap(p), a)
    made = ["known", *working]
    if "Authors" in wanted:
        p = p.withColumns({"people": F.col("_given.authors"), "contributors": F.col("_given.contributors")})
        made += ["people", "contributors"]
    p = settle(p.select(*parsed, *made), made)
    if "Authors" in wanted:
        p = p.withColumn("contributors", F.when(F.col("with_contributors") & (F.size("people") > 0), F.col("contributors")))
    if "Date" in wanted or "Chron" in wanted:
        is_keyword = approx_or_no_date("date_text").isNotNull()
        p = p.withColumn("date_parts", F.when(~is_keyword, parse_date("date_text", as_of_year)))
    embargo_open = F.lit(False)
    if as_of_date is not None:
        embargo_open = parse_date("embargo", as_of_year + 100)["start"] >= F.lit(as_of_date).cast("date")
    both = F.col("chapter").isNotNull() & F.col("title").isNotNull() & F.col("periodical").isNotNull()
    shift = both & (
        (F.col("cls") == "encyclopaedia") | ((F.col("cls") == "citation") & F.col("encyclopedia").isNotNull())
    )
    untitled = (
        (F.col("title") == "none")
        & F.col("cls").isin("journal", "citation")
        & (F.col("periodical_origin") == "journal")
    )
    title = F.when(F.coalesce(untitled, F.lit(False)), "").otherwise(F.col("title"))
    type_text = C.title_type("cls", F.when((F.col("cls") == "interview") & F.col("others").isNotNull(), F.lit(None))
                             .otherwise(F.col("type_given")), "degree")
    iso = F.col("date_parts")["iso"]
    values = {
        "Degree": F.col("degree"),
        "City": C.gazette_city("cls", "city"),
        "SeriesNumber": C.series_number_rule("cls", "series_number"),
        "AccessDate": F.col("access_date"),
        "Chapter": coins_title(F.when(shift, title).otherwise(F.col("chapter")), "script_chapter"),
        "PublisherName": F.col("publisher"),
        "Format": F.col("fmt"),
        "Title": coins_title(F.when(shift, F.col("periodical")).otherwise(title), "script_title"),
        "URL": C.url_rule("cls", "chapter_url", "url", F.try_element_at("ids", F.lit("PMC")), embargo_open),
        "Series": F.col("series"),
        "Encyclopedia": F.col("encyclopedia"),
        "Periodical": F.col("periodical"),
        "PublicationPlace": F.col("place"),
        "Date": iso,
        "Edition": F.col("edition"),
        "Pages": clean_pages("page_text"),
        "Chron": F.coalesce(F.col("date_parts")["chron"], F.when(iso.isNull(), F.col("date_text"))),
        "Issue": F.col("issue"),
        "Volume": F.col("volume"),
        "TitleType": F.when(F.col("cls") == "gnis", F.col("type_given")).otherwise(
            F.when(is_set(type_text), F.concat(F.lit(" ("), type_text, F.lit(")")))
        ),
    }
    failed, known_ = F.col("parse_failed"), F.col("known")
    names = [n for n in TEXT_FIELDS if n in wanted]
    chosen = F.when(F.size(F.coalesce("contributors", F.array())) > 0, F.col("contributors")).otherwise(F.col("people"))
    shown = F.transform(
        chosen,
        lambda x: F.struct(
            *[F.when(x[k].isNotNull(), W.strip_value(x[k])).alias(k) for k in ("last", "first", "link", "mask")]
        ),
    )
    authors_out = F.when(known_, shown).otherwise(F.slice(shown, F.lit(1), F.lit(0)))
    ids_out = F.when(known_, F.transform_values("ids", lambda _, v: W.strip_bound(v))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    # All text fields pass through one expression instead of nineteen copies of it.
    texts = F.transform(
        F.array(*[values[n] for n in names]) if names else F.array().cast("array<string>"),
        lambda v: F.when(v.isNull(), F.lit("")).otherwise(W.strip_bound(v)),
    )
    out = {"texts": F.when(known_, texts).otherwise(F.array_repeat(F.lit(""), len(names)))}
    out |= {n: v for n, v in (("Authors", authors_out), ("ID_list", ids_out)) if n in wanted}
    p = settle(p.withColumns(out), ["texts"])
    out = {n: F.get("texts", F.lit(i)) for i, n in enumerate(names)} | {n: F.col(n) for n in ("Authors", "ID_list")}
    if "Title" in wanted:
        out["Title"] = F.when(failed, NOT_PARSABLE).otherwise(out["Title"])
    taken = {n.lower() for n in wanted}
    given = [
        F.col(f"_in.`{c}`").alias(f"page_{c}" if c.lower() in taken else c)
        for c in df.columns
        if c not in ("template_name", "cls", "parse_failed")
    ]
    return p.select(*given, "template_name", "cls", "parse_failed", *[out[n].alias(n) for n in wanted])


def _when(cond: Column, **changes: Column):
    """Columns that change under a condition, read from the values before the change."""
    changed = {name: F.when(cond, value).otherwise(F.col(name)) for name, value in changes.items()}
    first = next(iter(changed))
    return changed | {first: unfused(changed[first])}


def _encyclopedia_remap(p: DataFrame) -> DataFrame:
    """An encyclopedia article: its title moves to the chapter and the work's name to the title."""
    null = F.lit(None).cast("string")
    applies = (
        (F.col("cls") == "encyclopaedia") | ((F.col("cls") == "citation") & F.col("encyclopedia").isNotNull())
    ) & F.col("periodical").isNotNull()
    has_title = F.col("title").isNotNull() | F.col("script_title").isNotNull()
    full = applies & has_title & F.col("chapter").isNull()
    only_work = applies & ~has_title
    linked = F.col("url").isNull() & F.col("title_link").isNotNull()
    return p.withColumns(
        {
            "chapter": F.when(
                full,
                F.when(
                    linked, F.concat(F.lit("[["), F.col("title_link"), F.lit("|"), F.coalesce("title", F.lit("")), F.lit("]]"))
                ).otherwise(F.col("title")),
            ).otherwise(F.col("chapter")),
            "script_chapter": F.when(full, F.col("script_title")).otherwise(F.col("script_chapter")),
            "chapter_url": F.when(full, F.col("url")).otherwise(F.col("chapter_url")),
            "title": F.when(full | only_work, F.col("periodical")).otherwise(F.col("title")),
            "periodical": F.when(full | only_work, null).otherwise(F.col("periodical")),
            "url": F.when(full, null).otherwise(F.col("url")),
            "fmt": F.when(full, null).otherwise(F.col("fmt")),
            "script_title": F.when(full, null).otherwise(F.col("script_title")),
        }
    )


def _class_remaps(p: DataFrame, alias: Callable[[str], Column]) -> DataFrame:
    """Rules of single classes: mailing list, conference, map, episode, serial, arXiv."""
    null = F.lit(None).cast("string")
    cls = F.col("cls")

    p = p.withColumn(
        "periodical",
        F.when(cls == "mailinglist", alias("MailingList"))
        .when(F.col("periodical_origin") == "mailinglist", null)
        .otherwise(F.col("periodical")),
    )
    book = (cls == "conference") & F.col("book_title").isNotNull()
    p = p.withColumns(
        _when(
            book,
            chapter=F.col("title"),
            chapter_url=F.col("url"),
            title=F.col("book_title"),
            fmt=null,
            url=null,
        )
    )
    is_map = cls == "map"
    p = p.withColumns(_when(is_map, chapter=alias("Map"), chapter_url=alias("MapURL")))

    episode, serial = cls == "episode", cls == "serial"
    numbering = F.array_join(
        F.array_compact(
            F.array(
                F.concat(F.lit("Season "), F.col("season")),
                F.when(F.col("season").isNull(), F.concat(F.lit("Series "), F.col("series_number"))),
                F.concat(F.lit("Episode "), F.col("issue")),
            )
        ),
        ". ",
    )
    link, has_url = F.col("title_link"), F.col("url").isNotNull()
    chapter = F.when(
        link.isNotNull() & ~has_url,
        F.concat(F.lit("[["), link, F.lit("|"), F.coalesce("title", F.lit("")), F.lit("]]")),
    ).otherwise(F.col("title"))
    numbered = F.when(
        link.isNotNull() & has_url, F.concat(F.lit("[["), link, F.lit("|"), numbering, F.lit("]]"))
    ).otherwise(first_set(numbering))
    p = p.withColumns(
        _when(
            episode,
            chapter=chapter,
            script_chapter=F.col("script_title"),
            chapter_url=F.col("url"),
            title=F.col("series"),
            series=numbered,
            url=null,
            script_title=null,
            issue=null,
        )
    )
    p = p.withColumns(_when(serial, chapter=alias("Episode"), issue=null))

    arxiv = cls == "arxiv"
    has_id = F.coalesce(F.map_contains_key("ids", F.lit("ARXIV")), F.lit(False))
    with_version = F.map_concat(
        F.map_filter("ids", lambda k, _: k != "ARXIV"),
        F.create_map(F.lit("ARXIV"), F.concat(F.try_element_at("ids", F.lit("ARXIV")), F.col("series"))),
    )
    other_ids = F.size(F.map_keys("ids")) > F.when(has_id, 1).otherwise(0)
    unsupported = F.coalesce("access_date", "chapter", "fmt", "page_text", "publisher", "url", "periodical").isNotNull()
    p = p.withColumns(
        {
            "ids": F.when(arxiv & has_id & F.col("series").isNotNull(), with_version).otherwise(F.col("ids")),
            "series": F.when(arxiv & has_id, null).otherwise(F.col("series")),
        }
        | _when(
            arxiv & (other_ids | unsupported),
            access_date=null,
            publisher=null,
            chapter=null,
            url=null,
            fmt=null,
            page_text=null,
        )
        | _when(arxiv, periodical=F.lit("arXiv"))
    )
    return p


def legacy_text(df: DataFrame) -> DataFrame:
    """`Authors` and `ID_list` as text, the way text-only readers expect them; empty when there is nothing."""
    ids = F.array_join(
        F.transform(
            F.map_entries("ID_list"), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'"))
        ),
        ", ",
    )
    return df.withColumns(
        {
            "Authors": people_text("Authors"),
            "ID_list": F.when(F.size("ID_list") > 0, F.concat(F.lit("{"), ids, F.lit("}"))).otherwise(""),
        }
    )


def minimal(df: DataFrame, citation: str = "citation") -> DataFrame:
    """The seven columns that labelling reads. `normalize_citations(fields=MINIMAL_FIELDS)` plans no more than these."""
    return df.select(
        "type_of_citation", "page_title", "Title", "URL", "Authors", "ID_list", F.col(citation).alias("citations")
    )


def compact_fields(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """All set text fields of a row as one map, empty ones left out."""
    names = fields or TEXT_FIELDS
    entries = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in names])
    return df.withColumn("fields", F.map_from_entries(F.filter(entries, lambda e: is_set(e["v"]))))
