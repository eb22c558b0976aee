"""Citation level column functions: type, class, aliases, positional parameters, field rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.core import (
    ColumnOrName,
    blank_to_null,
    col,
    first_set,
    first_values,
    in_list,
    is_set,
    let,
    lookup,
    matches,
)
from refloom.functions.dates import parse_date
from refloom.functions.wikitext import params_to_map
from refloom.tables.params import FIELD_ALIASES, ID_KINDS
from refloom.tables.templates import (
    CANONICAL_CLASSES,
    CLASSES_WITH_ACCESS_DATE,
    CLASSES_WITH_ISSUE,
    CLASSES_WITH_SERIES_NUMBER,
    CLASSES_WITH_VOLUME,
    CLASSES_WITHOUT_PAGES,
    GAZETTE_CITIES,
    GAZETTE_DEFAULT_CITY,
    LOWERED_CLASSES,
    TEMPLATE_NAMES,
    TITLE_TYPES,
)


def citation_type(citation: ColumnOrName, strict: bool = False) -> Column:
    """Lower-case template name up to the first bar.

    Braces go before trimming; with `strict` after it, so that `{{ cite journal` keeps a leading blank.
    """
    head = F.substring_index(F.substring_index(col(citation), "|", 1), "}}", 1)
    if strict:
        return F.replace(F.lower(F.trim(F.substring_index(col(citation), "|", 1))), F.lit("{{"), F.lit(""))
    return F.lower(F.regexp_replace(F.replace(head, F.lit("{{"), F.lit("")), r"^\s+|\s+$", ""))


def is_citation_template(name: ColumnOrName, lang: str = "en", strict: bool = False) -> Column:
    """Name is in the list of the language; the first letter may be of either case.

    Without `strict` the whole comparison ignores case, so that `cite arxiv` is found as well.
    """
    n = F.trim(col(name))
    if strict:
        n = F.concat(F.upper(F.substring(n, 1, 1)), F.substr(n, F.lit(2)))
        return in_list(n, TEMPLATE_NAMES[lang])
    return in_list(F.lower(n), [t.lower() for t in TEMPLATE_NAMES[lang]])


def last_word_class(name: ColumnOrName) -> Column:
    """Last word of the name, case kept but for a few names."""
    word = F.element_at(F.split(F.trim(col(name)), " ", -1), -1)
    return F.when(in_list(word, LOWERED_CLASSES), F.lower(word)).otherwise(word)


def citation_class(name: ColumnOrName, strict: bool = False) -> Column:
    """Class the field rules test. `strict` is the bare last word; the default also knows the two-word types
    (`cite press release` is `pressrelease`) and ignores case."""
    word = last_word_class(name)
    if strict:
        return word
    return F.coalesce(lookup(CANONICAL_CLASSES, F.lower(F.trim(col(name)))), F.lower(word))


def set_params(params: ColumnOrName) -> Column:
    """Parameters that hold something."""
    return F.map_filter(col(params), lambda _, v: v != "")


def alias(params: ColumnOrName, field: str, blanks: bool = True) -> Column:
    """Value of the first set parameter of a field, null when none is set.

    `blanks=False` is for a map that `set_params` made.
    """
    m = col(params)
    values = [F.try_element_at(m, F.lit(n)) for n in FIELD_ALIASES[field]]
    return first_set(*values) if blanks else F.coalesce(*values)


def field_values(params: ColumnOrName, fields: Iterable[str]) -> Column:
    """Values of many fields at once, in the order of `fields`, from a map that `set_params` made.

    One pass over a constant table of names; a separate expression per field would make the generated code of
    the stage too large to be compiled to machine code.
    """
    return first_values(col(params), [FIELD_ALIASES[f] for f in fields])


def alias_origin(params: ColumnOrName, field: str) -> Column:
    """Name of the parameter that fills a field."""
    m = col(params)
    return F.coalesce(*[F.when(is_set(F.try_element_at(m, F.lit(n))), n) for n in FIELD_ALIASES[field]])


def redundant_aliases(params: ColumnOrName, field: str) -> Column:
    """Parameters of a field beyond the one that is used."""
    m = col(params)
    names = [F.when(is_set(F.try_element_at(m, F.lit(n))), n) for n in FIELD_ALIASES[field]]
    found = F.array_compact(F.array(*names))
    return let(found, lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))))


def remap_positional(cls: ColumnOrName, params: ColumnOrName, as_of_year: int) -> Column:
    """Give unnamed and shop-specific parameters of a few template classes their common names."""
    c, m = col(cls), col(params)

    def new_name(e: Column) -> Column:
        k, kind = e["key"], e["kind"]
        by_kind = {
            # class, kind of value -> name for an unnamed parameter
            ("gnis", "number"): "seriesno",
            ("gnis", "date"): "accessdate",
            ("gnis", "text"): "title",
            ("season", "date"): "year",
        }
        unnamed = F.when(c.isin("nhle", "england"), "seriesno")
        for (cls_name, value_kind), name in by_kind.items():
            same = c.isin("gnis", "geonet3") if cls_name == "gnis" else c == cls_name
            unnamed = unnamed.when(same & (kind == value_kind), name)
        unnamed = unnamed.when(c == "season", "seriesno")
        unnamed = unnamed.when(
            c.isin("harvnb", "brackets"), F.when(e["digit"], "year").otherwise(F.concat(F.lit("last"), k))
        )
        unnamed = unnamed.when((c == "nrisref") & e["digit"], "series")
        unnamed = unnamed.when(c == "sports-reference", lookup({"1": "title", "2": "url", "3": "accessdate"}, k))
        named = lookup(
            {
                "nrisref name": "title", "nrisref refnum": "seriesno",
                "gnis id": "seriesno", "gnis name": "title",
                "geonet3 id": "seriesno", "geonet3 name": "title",
                "season id": "seriesno", "season name": "title", "season season": "year",
                "nhle num": "seriesno", "nhle desc": "title",
                "england num": "seriesno", "england desc": "title",
            },
            F.concat_ws(" ", c, k),
        )
        version = (c == "nrisref") & (k == "version") & e["digit"]
        return F.coalesce(F.when(e["numeric"], unnamed).when(version, "series").otherwise(named), k)

    def rename(entries: Column) -> Column:
        def described(e: Column) -> Column:
            numeric = matches(e["key"], r"^\d+$")
            asked = numeric & c.isin("gnis", "geonet3", "season")
            kind = (
                F.when(~asked, F.lit(None).cast("string"))
                .when(e["value"].try_cast("double").isNotNull() & (c != "season"), "number")
                .when(F.coalesce(parse_date(e["value"], as_of_year)["valid"], F.lit(False)), "date")
                .otherwise("text")
            )
            return F.struct(
                e["key"].alias("key"), e["value"].alias("value"), numeric.alias("numeric"),
                matches(e["value"], r"\d").alias("digit"), kind.alias("kind"),
            )

        renamed = F.transform(
            F.transform(entries, described),
            lambda e: F.struct(new_name(e).alias("name"), e["key"].alias("old"), e["value"].alias("value")),
        )

        # A renamed parameter replaces one that already has the name.
        return let(
            renamed,
            lambda r: params_to_map(
                F.concat(F.filter(r, lambda e: e["name"] == e["old"]), F.filter(r, lambda e: e["name"] != e["old"]))
            ),
        )

    special = in_list(
        c, ["harvnb", "brackets", "nrisref", "gnis", "geonet3", "season", "sports-reference", "nhle", "england"]
    )
    return F.when(special, let(F.array_sort(F.map_entries(m)), rename)).otherwise(m)


def volume_rule(cls: ColumnOrName, volume: ColumnOrName, periodical: ColumnOrName) -> Column:
    c = col(cls)
    return F.when(in_list(c, CLASSES_WITH_VOLUME) & ~((c == "conference") & ~is_set(col(periodical))), col(volume))


def issue_rule(cls: ColumnOrName, issue: ColumnOrName, periodical: ColumnOrName) -> Column:
    c = col(cls)
    return F.when(
        in_list(c, CLASSES_WITH_ISSUE) & ~(c.isin("conference", "map") & ~is_set(col(periodical))), col(issue)
    )


def page_rule(cls: ColumnOrName, value: ColumnOrName) -> Column:
    return F.when(~in_list(col(cls), CLASSES_WITHOUT_PAGES), col(value))


def access_date_rule(cls: ColumnOrName, value: ColumnOrName) -> Column:
    return F.when(in_list(col(cls), CLASSES_WITH_ACCESS_DATE), col(value))


def series_number_rule(cls: ColumnOrName, value: ColumnOrName) -> Column:
    return F.when(in_list(col(cls), CLASSES_WITH_SERIES_NUMBER), col(value))


def choose_pages(sheet, sheets, page, pages, at) -> Column:
    """One page text out of the five page parameters."""
    return first_set(*[col(x) for x in (sheet, sheets, page, pages, at)])


def place_rule(publication_place: ColumnOrName, place: ColumnOrName) -> Column:
    return first_set(col(publication_place), col(place))


def date_promotion(date, year, publication_date, air_date) -> Column:
    """The date is the date, else the air date, the year or the publication date."""
    return first_set(col(date), col(air_date), col(year), col(publication_date))


def title_type(cls: ColumnOrName, given: ColumnOrName, degree: ColumnOrName) -> Column:
    """Given type, or the default of the class; `none` switches it off; a thesis shows its degree."""
    c, g, d = col(cls), blank_to_null(col(given)), blank_to_null(col(degree))
    by_class = F.when(g == "none", F.lit(None).cast("string")).otherwise(F.coalesce(g, lookup(TITLE_TYPES, c)))
    value = F.when(in_list(c, list(TITLE_TYPES)), by_class).otherwise(g)
    return F.when(
        in_list(c, list(TITLE_TYPES)) & d.isNotNull() & (value == "Thesis"), F.concat(d, F.lit(" thesis"))
    ).otherwise(value)


def gazette_city(cls: ColumnOrName, city: ColumnOrName) -> Column:
    return F.when(
        col(cls) == "gazette",
        F.coalesce(lookup(GAZETTE_CITIES, F.lower(col(city))), F.lit(GAZETTE_DEFAULT_CITY)),
    ).otherwise(col(city))


def url_rule(cls, chapter_url, url, pmc, embargoed) -> Column:
    """Chapter address first; a journal article without an address takes the open PMC address."""
    pmc_url = F.concat(F.lit(ID_KINDS["PMC"][1]), col(pmc))
    free = (col(cls) == "journal") & ~is_set(col(url)) & is_set(col(pmc)) & ~F.coalesce(embargoed, F.lit(False))
    return first_set(col(chapter_url), F.when(free, pmc_url), col(url))
