"""Text rules of single citation fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.core import ColumnOrName, col, in_list, is_set, let, matches
from refloom.functions.wikitext import strip_apostrophes
from refloom.tables.params import KEYWORD_PARAMS, KEYWORDS

# Named groups of characters that do not show, in the order they are tested.
INVISIBLE_GROUPS = [
    ("replacement", "�"),
    ("zero width joiner", "‍"),
    ("zero width space", "​"),
    ("hair space", " "),
    ("soft hyphen", "­"),
    ("horizontal tab", r"\t"),
    ("line feed", r"\n"),
    ("carriage return", r"\r"),
    ("stripmarker", r"\x7fUNIQ--[A-Za-z]+-[A-Za-z0-9]+-QINU\x7f"),
    ("delete", r"\x7f"),
    ("C0 control", r"[\x01-\x08\x0b\x0c\x0e-\x1f]"),
    ("C1 control", r"[\x80-\x9f]"),
    ("Specials", r"[￹-￿]"),
    ("Private use area", r"[-]"),
    ("Supplementary Private Use Area-A", r"[\x{f0000}-\x{ffffd}]"),
    ("Supplementary Private Use Area-B", r"[\x{100000}-\x{10fffd}]"),
]


def coins_title(title: ColumnOrName, script: ColumnOrName | None = None) -> Column:
    """Title without bold and italic marks, followed by the foreign script title without its language prefix."""
    if script is None:
        return F.coalesce(strip_apostrophes(title), F.lit(""))
    plain = F.regexp_replace(col(script), r"^[a-z]{2}\s*:\s*", "")
    return F.array_join(
        F.filter(F.array(strip_apostrophes(title), strip_apostrophes(plain)), lambda v: v != ""), " "
    )


def clean_pages(pages: ColumnOrName) -> Column:
    """Page text without external links and brackets; en dashes and entities become hyphens."""
    c = F.regexp_replace(col(pages), r"\[\w*:?//[^ ]+\s+(?=[\w].*\])", "")
    return F.regexp_replace(F.translate(c, "–[]", "-"), r"&\w+;", "-")


def hyphen_to_dash(text: ColumnOrName) -> Column:
    """Hyphens as en dashes, unless the text holds brackets or markup."""
    c = col(text)
    return F.when(matches(c, r"[\[\]{}<>]"), c).otherwise(F.translate(c, "-", "–"))


def clean_invisible(text: ColumnOrName) -> Column:
    """Zero-width characters and soft hyphens go, no-break blanks become blanks."""
    c = F.translate(col(text), "​‌‍﻿­", "")
    return F.regexp_replace(F.translate(c, " ", " "), r"&(?:zwj|zwnj|shy);", "")


def invisible_chars(text: ColumnOrName) -> Column:
    """`array<struct<group,position>>` of the first hit of each group of invisible characters."""
    any_group = "|".join(pattern for _, pattern in INVISIBLE_GROUPS)

    def hits(c: Column) -> Column:
        found = [
            F.when(
                matches(c, pattern),
                F.struct(
                    F.lit(group).alias("group"),
                    (F.length(F.split(c, pattern, 2)[0]) + 1).alias("position"),
                ),
            )
            for group, pattern in INVISIBLE_GROUPS
        ]
        return F.when(matches(c, any_group), F.array_compact(F.array(*found))).otherwise(
            F.array().cast("array<struct<group:string,position:int>>")
        )

    return let(col(text), hits)


def any_invisible(text: ColumnOrName) -> Column:
    """Some character of `invisible_chars` is in a text. A stripmarker begins with the delete character."""
    single = "".join(pattern.strip("[]") for name, pattern in INVISIBLE_GROUPS if name != "stripmarker")
    return matches(col(text), f"[{single}]")


def extra_page_text(pages: ColumnOrName) -> Column:
    """The page value repeats `p.`, `pp.` or `page`."""
    c = col(pages)
    return ~matches(c, r"^P[^.Pp]") & (matches(c, r"^[Pp]?[Pp]\.?[ \d]") | matches(c, r"^[Pp]ages?"))


def valid_keyword(value: ColumnOrName, name: str) -> Column:
    """Value allowed for a keyword parameter; an empty value is fine."""
    c = col(value)
    return ~is_set(c) | in_list(F.lower(c), KEYWORDS[KEYWORD_PARAMS.get(name, name)])


def legacy_id_pairs(text: ColumnOrName) -> Column:
    """`map<kind,value>` from the text form `{'DOI': '10.1/x', 'PMID': '3'}` or `{DOI=10.1/x, PMID=3}`."""
    c = col(text)
    pattern = r"(?:'([A-Z]+)'\s*:\s*'((?:[^'\\]|\\.)*)')|(?:(?:^\{?|[,{]\s*)([A-Z]+)\s*=\s*(.*?)(?=,\s*[A-Z]+\s*=|\}?$))"
    raw = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pairs = F.transform(
        raw,
        lambda r: F.struct(
            F.concat(F.regexp_extract(r, pattern, 1), F.regexp_extract(r, r"^[{,\s]*([A-Z]+)\s*=", 1)).alias("k"),
            F.when(matches(r, r"^'"), F.regexp_extract(r, pattern, 2))
            .otherwise(F.trim(F.regexp_extract(r, r"^[{,\s]*[A-Z]+\s*=(.*)$", 1)))
            .alias("v"),
        ),
    )
    return F.map_from_entries(
        F.filter(
            pairs,
            lambda p: p["k"] != "",
        )
    )


def csv_array(text: ColumnOrName) -> Column:
    """`['a' 'b', 'c']` written to CSV, back to an array: quotes, brackets and line ends off, split at commas."""
    return F.split(F.regexp_replace(col(text), r"['\[\]\n]", ""), ",", -1)
