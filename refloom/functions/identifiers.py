"""Identifier checks as column expressions; every function returns true or false, never null for a set value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.core import ColumnOrName, col, first_values, in_list, is_set, let, matches
from refloom.tables.params import ID_KINDS

# Highest numbers accepted.
PMID_LIMIT = 30_000_000
PMC_LIMIT = 5_000_000

# Country shops that need a second-level domain.
SHOP_CO = ["jp", "uk"]
SHOP_COM = ["au", "br", "mx"]


def _digit(c: Column, i: int) -> Column:
    """Value of character `i` (from 1); X counts ten."""
    ch = F.substring(c, i, 1)
    return F.when(ch == "X", 10).otherwise(F.ascii(ch) - 48)


def _mod11(c: Column, length: int) -> Column:
    total = F.lit(0)
    for i in range(1, length + 1):
        total = total + _digit(c, i) * (length + 1 - i)
    return total % 11 == 0


def _mod10(c: Column) -> Column:
    total = F.lit(0)
    for i in range(1, 14):
        total = total + _digit(c, i) * (1 if i % 2 else 3)
    return total % 10 == 0


def clean_isbn(isbn: ColumnOrName) -> Column:
    """Only digits, hyphens and X stay."""
    return F.regexp_replace(col(isbn), r"[^-0-9X]", "")


def valid_isbn(isbn: ColumnOrName) -> Column:
    def check(bare: Column) -> Column:
        return (
            F.when(matches(bare, r"^\d{9}[\dX]$"), _mod11(bare, 10))
            .when(matches(bare, r"^97[89]\d{10}$"), _mod10(bare))
            .otherwise(False)
        )

    c = col(isbn)
    return F.when(matches(c, r"[^\s\-0-9X]"), False).otherwise(let(F.regexp_replace(c, r"[-\s]", ""), check))


def valid_ismn(ismn: ColumnOrName) -> Column:
    bare = F.regexp_replace(col(ismn), r"[-\s–]", "")
    return let(bare, lambda b: F.when(matches(b, r"^9790\d{9}$"), _mod10(b)).otherwise(False))


def valid_issn(issn: ColumnOrName) -> Column:
    bare = F.regexp_replace(col(issn), r"[-\s–]", "")
    return let(bare, lambda b: F.when(matches(b, r"^\d{7}[\dX]$"), _mod11(b, 8)).otherwise(False))


def format_issn(issn: ColumnOrName) -> Column:
    """`dddd-dddd` for a valid number, otherwise the value as given."""
    c = col(issn)
    bare = F.regexp_replace(c, r"[-\s–]", "")
    return F.when(valid_issn(c), F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 4))).otherwise(c)


def valid_doi(doi: ColumnOrName) -> Column:
    return matches(col(doi), r"^10\.[^\s–]*?/[^\s–]*?[^.,]$")


def _number_up_to(c: Column, limit: int) -> Column:
    return F.when(matches(c, r"^\d+$"), F.coalesce(c.try_cast("bigint").between(1, limit), F.lit(False))).otherwise(
        False
    )


def valid_pmid(pmid: ColumnOrName) -> Column:
    return _number_up_to(col(pmid), PMID_LIMIT)


def valid_pmc(pmc: ColumnOrName) -> Column:
    return _number_up_to(col(pmc), PMC_LIMIT)


def valid_arxiv(arxiv: ColumnOrName) -> Column:
    """Three generations: `archive/YYMMNNN` 9107–0703, `YYMM.NNNN` 0704–1412, `YYMM.NNNNN` from 1501."""
    c = col(arxiv)
    old, mid, new = (
        r"^[A-Za-z][A-Za-z.\-]+/([90]\d)([01]\d)\d{3}(?:v\d+)?$",
        r"^(\d\d)([01]\d)\.\d{4}(?:v\d+)?$",
        r"^(\d\d)([01]\d)\.\d{5}(?:v\d+)?$",
    )

    def ym(pattern: str) -> tuple[Column, Column]:
        return (
            F.regexp_extract(c, pattern, 1).try_cast("int"),
            F.regexp_extract(c, pattern, 2).try_cast("int"),
        )

    (y1, m1), (y2, m2), (y3, m3) = ym(old), ym(mid), ym(new)
    ok_old = (
        ((y1 > 90) | (y1 < 8)) & m1.between(1, 12) & ~((y1 == 91) & (m1 < 7)) & ~((y1 == 7) & (m1 > 3))
    )
    ok_mid = y2.between(7, 14) & m2.between(1, 12) & ~((y2 == 7) & (m2 < 4))
    ok_new = (y3 >= 15) & m3.between(1, 12)
    return (
        F.when(matches(c, old), ok_old).when(matches(c, mid), ok_mid).when(matches(c, new), ok_new).otherwise(False)
    )


def normalize_lccn(lccn: ColumnOrName) -> Column:
    """Without blanks, cut at a slash, the part after the last hyphen filled to six digits."""
    c = F.regexp_replace(col(lccn), r"\s", "")
    c = F.regexp_extract(c, r"^([^/]*)", 1)
    tail = F.regexp_extract(c, r"^.+-(.+)$", 1)
    filled = F.when(F.length(tail) < 6, F.lpad(tail, 6, "0")).otherwise(tail)
    return F.when(tail != "", F.concat(F.regexp_extract(c, r"^(.+)-.+$", 1), filled)).otherwise(c)


def valid_lccn(lccn: ColumnOrName) -> Column:
    """Shape by length 8 to 12; the value as given must hold no blank."""
    c = col(lccn)
    n = normalize_lccn(c)
    shape = (
        matches(n, r"^\d{8}$")
        | matches(n, r"^[a-z]\d{8}$")
        | matches(n, r"^(?:\d\d|[a-z]{2})\d{8}$")
        | matches(n, r"^(?:[a-z]{3}\d{8}|[a-z]\d{10})$")
        | matches(n, r"^[a-z]{2}\d{10}$")
    )
    return shape & ~matches(c, r"\s")


def valid_asin(asin: ColumnOrName) -> Column:
    """Ten capitals or digits; with only digits it must be an ISBN-10, otherwise it starts with a capital."""
    c = col(asin)
    return F.when(matches(c, r"^\d{9}[\dX]$"), valid_isbn(c)).otherwise(matches(c, r"^[A-Z][\dA-Z]{9}$"))


def asin_domain(tld: ColumnOrName) -> Column:
    c = col(tld)
    return (
        F.when(~is_set(c), "com")
        .when(in_list(c, SHOP_CO), F.concat(F.lit("co."), c))
        .when(in_list(c, SHOP_COM), F.concat(F.lit("com."), c))
        .otherwise(c)
    )


def valid_ol(ol: ColumnOrName) -> Column:
    return matches(col(ol), r"^\d+[AMW]$")


def ol_path(ol: ColumnOrName) -> Column:
    """Library path by the closing letter: author, book (manifestation) or work."""
    kind = F.regexp_extract(col(ol), r"^\d+([AMW])$", 1)
    return (
        F.when(kind == "A", "authors/OL").when(kind == "M", "books/OL").when(kind == "W", "works/OL").otherwise("OL")
    )


def valid_message_id(message_id: ColumnOrName) -> Column:
    c = col(message_id)
    return matches(c, r"^.+@.+$") & matches(c, r"^[^<].*[^>]$")


VALIDATORS = {
    "ARXIV": valid_arxiv,
    "ASIN": valid_asin,
    "DOI": valid_doi,
    "ISBN": valid_isbn,
    "ISMN": valid_ismn,
    "ISSN": valid_issn,
    "LCCN": valid_lccn,
    "OL": valid_ol,
    "PMC": valid_pmc,
    "PMID": valid_pmid,
    "USENETID": valid_message_id,
}


def valid_id(kind: ColumnOrName, value: ColumnOrName) -> Column:
    """Check by kind; kinds without a check are accepted."""
    k, v = col(kind), col(value)
    out = F.when(v.isNull(), F.lit(None).cast("boolean"))
    for name, check in VALIDATORS.items():
        out = out.when(k == name, check(v))
    return out.otherwise(True)


def extract_ids(params: ColumnOrName) -> Column:
    """`map<kind, value>` of all identifiers set in a parameter map, kinds in alphabetic order."""
    given = F.map_filter(col(params), lambda _, v: v != "")
    kinds = F.split(F.lit("|".join(ID_KINDS)), r"\|")

    def pair(m: Column) -> Column:
        values = first_values(m, [names for names, _ in ID_KINDS.values()])
        return F.filter(
            F.zip_with(kinds, values, lambda k, v: F.struct(k.alias("kind"), v.alias("value"))),
            lambda e: e["value"].isNotNull(),
        )

    return F.map_from_entries(let(given, pair))


def id_url(kind: ColumnOrName, value: ColumnOrName, asin_tld: Column | None = None) -> Column:
    """Resolver address of an identifier; null for kinds without a resolver."""
    k, v = col(kind), col(value)
    out = F.when(k == "ASIN", F.concat(
        F.lit(ID_KINDS["ASIN"][1]), asin_domain(asin_tld if asin_tld is not None else F.lit("")), F.lit("/dp/"), v
    ))
    out = out.when(k == "OL", F.concat(F.lit(ID_KINDS["OL"][1]), ol_path(v), v))
    for name, (_, prefix) in ID_KINDS.items():
        if name not in ("ASIN", "OL") and prefix:
            out = out.when(k == name, F.concat(F.lit(prefix), v))
    return out
