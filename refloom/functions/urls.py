"""Addresses: shape checks and the registered domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.core import ColumnOrName, col, is_set, let, matches

# Parts dropped before the domain of an address is read, in this order.
DROPPED_PARTS = [
    "https://", "www.", "youtube.com/", "instagram.com/", "facebook.com/", "twitter.com/", "pinterest.com/",
    "user/", "plus.google.com/",
]

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk",
    "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "com.br", "edu.br", "gov.br", "net.br", "org.br",
    "ac.za", "co.za", "gov.za", "org.za",
    "ac.in", "co.in", "gov.in", "net.in", "org.in",
    "ac.kr", "co.kr", "go.kr", "or.kr",
    "com.tr", "edu.tr", "gov.tr", "org.tr",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.mx", "edu.mx", "gob.mx", "org.mx",
    "com.ar", "edu.ar", "gob.ar", "org.ar",
    "ac.il", "co.il", "gov.il", "org.il",
    "com.hk", "edu.hk", "gov.hk", "org.hk",
    "com.sg", "edu.sg", "gov.sg", "org.sg",
    "com.tw", "edu.tw", "gov.tw", "org.tw",
]
# Second labels that make a suffix with any two-letter country, where no list of suffixes is given.
SECOND_LABELS = ["ac", "co", "com", "edu", "gob", "gov", "net", "or", "org"]


def split_url(url: ColumnOrName) -> Column:
    """`struct<scheme,domain>`: the path is cut off; a colon must be followed by no or two slashes."""
    c = F.regexp_replace(col(url), r"([A-Za-z])/.*", "$1")
    relative = matches(c, r"^//\S*")
    parts = r"(\S*?:)(/*)(\S+)"
    slashes = F.regexp_extract(c, parts, 2)
    fits = matches(c, parts)
    return F.struct(
        F.when(~relative & fits, F.regexp_extract(c, parts, 1)).alias("scheme"),
        F.when(relative, F.regexp_extract(c, r"^//(\S*)", 1))
        .when(fits & slashes.isin("", "//"), F.regexp_extract(c, parts, 3))
        .alias("domain"),
    )


_HOST_SHAPES = [
    r"(?<![A-Za-z\d])[A-Za-z\d]\.org$",
    r"(?<![A-Za-z])[qxz]\.com$",
    r"(?<![A-Za-z])[iq]\.net$",
    r"(?<![A-Za-z\d])[A-Za-z\d]\.[A-Za-z]{2}$",
    r"(?<![A-Za-z\d])[A-Za-z\d]{2}\.[A-Za-z]{2,}$",
    r"(?<![A-Za-z\d])[A-Za-z\d][A-Za-z\d\-]+[A-Za-z\d]\.[A-Za-z]{2,}$",
    r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
]


def valid_domain(domain: ColumnOrName) -> Column:
    """Host name of an accepted shape, or an IPv4 address."""
    c = F.regexp_replace(col(domain), r"^//", "")
    shape = F.lit(False)
    for pattern in _HOST_SHAPES:
        shape = shape | matches(c, pattern)
    return matches(c, r"^[A-Za-z\d]") & shape


def _scheme_and_domain_ok(scheme: Column, domain: Column) -> Column:
    return (~is_set(scheme) | matches(scheme, r"^[A-Za-z][A-Za-z\d+.\-]*:")) & valid_domain(domain)


def valid_url(url: ColumnOrName) -> Column:
    c = col(url)
    return matches(c, r"^\S+$") & let(split_url(c), lambda u: _scheme_and_domain_ok(u["scheme"], u["domain"]))


def has_external_link(text: ColumnOrName) -> Column:
    """An address anywhere in a text, bracketed or bare."""
    forms = [
        (r"(?<!\[)\[([A-Za-z]\S*:)(\S+).*\]", True),
        (r"(?<!\[)\[//(\S*\.\S+).*\]", False),
        (r"([A-Za-z]\S*:)(\S+)", True),
        (r"//(\S*\.\S+)", False),
    ]

    def found(c: Column) -> Column:
        out = F.when(c.isNull(), False)
        for pattern, with_scheme in forms:
            scheme = F.regexp_extract(c, pattern, 1) if with_scheme else F.lit("")
            domain = F.regexp_extract(c, pattern, 2 if with_scheme else 1)
            out = out.when(matches(c, pattern), _scheme_and_domain_ok(scheme, domain))
        return out.otherwise(False)

    whole = col(text)
    # Every form has a colon or two slashes, which cutting the paths does not bring about.
    may = F.coalesce(F.contains(whole, F.lit(":")) | F.contains(whole, F.lit("//")), F.lit(False))
    return F.when(may, let(F.regexp_replace(whole, r"([^\s/])/[A-Za-z\d].*", "$1"), found)).otherwise(False)


def link_param_ok(value: ColumnOrName) -> Column:
    """A page name: no markup characters and no address."""
    c = col(value)
    return ~matches(c, r"[<>\[\]|{}]") & ~let(
        split_url(c), lambda u: _scheme_and_domain_ok(u["scheme"], u["domain"])
    )


def is_pdf(url: ColumnOrName) -> Column:
    return matches(col(url), r"\.(?:pdf|PDF)(?:$|[?#])")


def default_format(fmt: ColumnOrName, url: ColumnOrName) -> Column:
    return F.when(is_set(col(fmt)), col(fmt)).when(is_pdf(url), "PDF")


def host_labels(url: ColumnOrName) -> Column:
    """Labels of the host of an address, lower-cased: `https://www.bbc.co.uk/news` gives www, bbc, co, uk.

    Social hosts and `user/` are cut off first, so the account name is read instead. Text without a usable host gives
    one empty label.
    """
    c = F.coalesce(col(url), F.lit(""))
    for part in DROPPED_PARTS:
        c = F.replace(c, F.lit(part), F.lit(""))
    pattern = r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)?(?:[^/@\s?#]*@)?([^/:?#\s]*)"
    return let(c, lambda t: F.split(F.regexp_replace(F.lower(F.regexp_extract(t, pattern, 1)), r"\.+$", ""), r"\.", -1))


def ending(labels: Column, size: int) -> Column:
    """The last `size` labels of a host as text, null for a host of fewer."""
    return F.when(F.size(labels) >= size, F.array_join(F.slice(labels, -size, size), "."))


def label_before(labels: Column, size: Column) -> Column:
    """The label in front of a suffix of `size` labels; a numeric address whole, a host of one label itself."""
    return (
        F.when(matches(F.array_join(labels, "."), r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.array_join(labels, "."))
        .when(F.size(labels) == 1, F.element_at(labels, 1))
        .otherwise(F.coalesce(F.try_element_at(labels, -size - 1), F.lit("")))
    )


def top_domain(url: ColumnOrName, suffixes: list[str] | None = None) -> Column:
    """Registered domain without its public suffix: `https://www.bbc.co.uk/news` gives `bbc`.

    suffixes: the public suffixes of several labels, longest match first; other hosts end in a suffix of one label. Without
    it, the known suffixes of two labels are used, and a usual second label under any two-letter country. A whole public
    suffix list is a table: see `operators.labels.with_domain`.
    """

    def pick(parts: Column) -> Column:
        n = F.size(parts)
        if suffixes is None:
            second, last = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
            usual = second.isin(*SECOND_LABELS) & matches(last, "^[a-z]{2}$") & (n > 2)
            size = F.when(F.concat_ws(".", second, last).isin(*TWO_LABEL_SUFFIXES) | usual, 2).otherwise(1)
        else:
            size = F.lit(1)
            for k in sorted({x.count(".") + 1 for x in suffixes} - {1}):
                listed = [x for x in suffixes if x.count(".") + 1 == k]
                size = F.when(F.coalesce(ending(parts, k).isin(*listed), F.lit(False)), k).otherwise(size)
        return let(size, lambda k: label_before(parts, k))

    return let(host_labels(url), pick)


def is_google_book(url: ColumnOrName) -> Column:
    return F.coalesce(col(url).startswith("https://books.google.com/books?id="), F.lit(False))
