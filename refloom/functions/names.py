"""People lists of a citation: numbered names, name strings, et al."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.core import ColumnOrName, blank_to_null, col, is_set, let, lookup, matches
from refloom.tables.params import NAME_LISTS

PERSON = "struct<last:string,first:string,link:string,mask:string>"

ET_AL = r"""[;,]? *["']*(?<![A-Za-z])[Ee][Tt] *[Aa][Ll][."']*$"""
AND_OTHERS = r"[;,]? *(?<![A-Za-z])and [Oo]thers"


def has_et_al(text: ColumnOrName) -> Column:
    c = col(text)
    return matches(c, ET_AL) | matches(c, AND_OTHERS)


def strip_et_al(text: ColumnOrName) -> Column:
    """Text without a closing `et al.`, or without `and others`."""
    def strip(c: Column) -> Column:
        return (
            F.when(~matches(c, "(?i)al|others"), c)
            .when(matches(c, ET_AL), F.regexp_replace(c, ET_AL, ""))
            .otherwise(F.regexp_replace(c, AND_OTHERS, ""))
        )

    return let(col(text), strip)


def person_codes(kind: str) -> dict[str, str]:
    """Parameter name with `#` for the number -> part and rank, a bare name ranks right before number 1."""
    letters = {"last": "l", "first": "f", "link": "k", "mask": "m"}
    codes: dict[str, str] = {}
    for part, names in NAME_LISTS[kind].items():
        for i, n in enumerate(names):
            codes.setdefault(n, f"{letters[part]}{2 * i + 1:02d}")
            codes.setdefault(n.replace("#", ""), f"{letters[part]}{2 * i:02d}")
    return codes


def people(params: ColumnOrName, kind: str = "author") -> Column:
    """Numbered people of one kind as `array<struct<last,first,link,mask>>`.

    Numbers are read in order until two in a row have neither a first nor a last name; a first name without a
    last name is left out.
    """
    codes = person_codes(kind)
    starts = "^(?:" + "|".join(sorted({re.match("[a-z]+", n).group() for n in codes})) + ")"
    no_people = F.array().cast(f"array<{PERSON}>")

    def entries(m: Column) -> Column:
        """Set name parameters as (number, code, value), best rank first."""
        listed = F.transform(
            F.filter(F.map_entries(m), lambda e: matches(e["key"], starts)),
            lambda e: F.struct(
                F.coalesce(F.regexp_extract(e["key"], r"([0-9]+)", 1).try_cast("int"), F.lit(1)).alias("no"),
                lookup(codes, F.regexp_replace(e["key"], r"[0-9]+", "#")).alias("code"),
                e["value"].alias("value"),
            ),
        )
        return F.array_sort(F.filter(listed, lambda e: e["code"].isNotNull() & is_set(e["value"])))

    def pick(found: Column, no: Column, part: str) -> Column:
        return F.try_element_at(
            F.filter(found, lambda e: (e["no"] == no) & e["code"].startswith(part)), F.lit(1)
        )["value"]

    def walk(found: Column) -> Column:
        named = F.filter(found, lambda e: e["code"].rlike("^[lf]"))
        numbers = F.array_sort(F.array_distinct(F.transform(named, lambda e: e["no"])))
        start = F.struct(
            F.lit(0).alias("at"), F.lit(0).alias("gaps"), F.array().cast("array<int>").alias("kept")
        )

        def step(acc: Column, no: Column) -> Column:
            # Numbers that are not there count as gaps; two in a row end the list for good.
            gaps = F.when(acc["gaps"] >= 2, acc["gaps"]).otherwise(acc["gaps"] + no - acc["at"] - 1)
            has_last = F.exists(named, lambda e: (e["no"] == no) & e["code"].startswith("l"))
            return let(
                F.struct(gaps.alias("gaps"), has_last.alias("last")),
                lambda s: F.struct(
                    no.alias("at"),
                    F.when((s["gaps"] < 2) & s["last"], F.lit(0)).otherwise(s["gaps"]).alias("gaps"),
                    F.when((s["gaps"] < 2) & s["last"], F.concat(acc["kept"], F.array(no)))
                    .otherwise(acc["kept"])
                    .alias("kept"),
                ),
            )

        return F.transform(
            F.aggregate(numbers, start, step, lambda acc: acc["kept"]),
            lambda no: F.struct(
                strip_et_al(pick(found, no, "l")).alias("last"),
                strip_et_al(pick(found, no, "f")).alias("first"),
                pick(found, no, "k").alias("link"),
                pick(found, no, "m").alias("mask"),
            ),
        )

    return let(entries(col(params)), lambda f: F.when(F.size(f) > 0, walk(f)).otherwise(no_people))


def vancouver_names(text: ColumnOrName) -> Column:
    """Names of a Vancouver style list: `Last AB, Last CD, ((Corporation))`."""
    names = F.split(F.trim(strip_et_al(text)), r"\s*,\s*", -1)

    def read(n: Column) -> Column:
        corporate = matches(n, r"^\(\(.+\)\)$")
        spaced = matches(n, r"\s")
        return F.struct(
            F.when(corporate, F.regexp_extract(n, r"^\(\((.+)\)\)$", 1))
            .when(spaced, F.regexp_replace(F.regexp_extract(n, r"^(.*)\s\S*$", 1), r"\s", " "))
            .otherwise(n)
            .alias("last"),
            F.when(corporate, F.lit(""))
            .when(spaced, F.regexp_extract(n, r"\s(\S*)$", 1))
            .otherwise(F.lit(""))
            .alias("first"),
            F.lit(None).cast("string").alias("link"),
            F.lit(None).cast("string").alias("mask"),
        )

    return F.transform(names, read)


def author_source(params: ColumnOrName, kind: str = "author") -> Column:
    """Which parameters give the names: `numbered`, then `vancouver`, then `text`, else `none`."""
    m = col(params)

    def value(name: str) -> Column:
        return blank_to_null(F.try_element_at(m, F.lit(name)))

    lasts = NAME_LISTS[kind]["last"]
    usable = [n.replace("#", no) for n in lasts for no in ("", "1", "2")]
    numbered = F.exists(F.map_entries(m), lambda e: e["key"].isin(*usable) & is_set(e["value"]))
    plain = {"author": ["authors", "people", "host", "credits"], "editor": ["editors"]}.get(kind, [])
    vanc = {"author": "vauthors", "editor": "veditors"}.get(kind)
    out = F.when(numbered, "numbered")
    if vanc:
        out = out.when(value(vanc).isNotNull(), "vancouver")
    if plain:
        out = out.when(F.coalesce(*[value(p) for p in plain]).isNotNull(), "text")
    return out.otherwise("none")


def authors(params: ColumnOrName, kind: str = "author", free_text: bool = False) -> Column:
    """People from the winning source. A free text list has no structure: it gives no people, or with
    `free_text` one entry with the text as last name."""
    m = col(params)
    plain = {"author": ["authors", "people", "host", "credits"], "editor": ["editors"]}.get(kind, [])
    vanc = {"author": "vauthors", "editor": "veditors"}.get(kind)

    def read(source: Column) -> Column:
        out = F.when(source == "numbered", people(m, kind))
        if vanc:
            out = out.when(source == "vancouver", vancouver_names(F.try_element_at(m, F.lit(vanc))))
        if plain and free_text:
            text = F.coalesce(*[blank_to_null(F.try_element_at(m, F.lit(p))) for p in plain])
            none = F.lit(None).cast("string")
            out = out.when(
                source == "text",
                F.array(F.struct(text.alias("last"), none.alias("first"), none.alias("link"), none.alias("mask"))),
            )
        return out.otherwise(F.array().cast(f"array<{PERSON}>"))

    return let(author_source(m, kind), read)


def people_text(names: ColumnOrName) -> Column:
    """`Last, First; Last, First`."""
    return F.array_join(F.transform(col(names), lambda p: F.concat_ws(", ", p["last"], blank_to_null(p["first"]))), "; ")
