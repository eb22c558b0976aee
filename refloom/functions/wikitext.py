"""Column functions over wikitext: names, parameters, links, headings, tags, entities and plain text."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.braces import OPAQUE_PATTERN
from refloom.functions.core import (
    ColumnOrName,
    col,
    is_set,
    let,
    lookup,
    matches,
    pieces_and_tokens,
    scan,
    trim_all,
)
from refloom.tables.markup import (
    INVISIBLE_TAGS,
    LIST_TAGS,
    SCHEMES_WITH_SLASHES,
    SCHEMES_WITHOUT_SLASHES,
    SINGLE_TAGS,
    VOID_TAGS,
)

# A link opener counts only when the link closes again before another bracket.
PARAM_MARKS = (
    r"(?is)(?=[<{}\[\]|])(?:" + OPAQUE_PATTERN + r"|\{{2,}|\}{2,}|\[\[(?=[^\[\]]*+\]\])|\]\]|\|)"
)


# --- templates -------------------------------------------------------------------------------------------


def template_name(template: ColumnOrName) -> Column:
    """Name of a template: the text before the first bar, trimmed, comments dropped."""
    body = F.regexp_extract(col(template), r"(?s)^\{\{(.*?)(?:\||\}\}$)", 1)
    return F.regexp_replace(trim_all(F.regexp_replace(body, r"(?s)<!--.*?-->", "")), r"\s+", " ")


def _split_top_level(body: Column) -> Column:
    """Split at bars outside nested templates, links, comments and opaque tags."""

    def step(state: Column, item: Column) -> Column:
        token = item["tok"]
        text = F.concat(state["text"], item["gap"])
        cut = (token == "|") & (state["depth"] == 0)
        change = (
            F.when(token.startswith("{"), F.length(token))
            .when(token.startswith("}"), -F.length(token))
            .when(token == "[[", 2)
            .when(token == "]]", -2)
            .otherwise(0)
        )
        return F.struct(
            F.struct(
                F.greatest(F.lit(0), state["depth"] + change).alias("depth"),
                F.when(cut, "").otherwise(F.concat(text, token)).alias("text"),
            ).alias("state"),
            F.when(cut, F.array(text)).otherwise(F.array().cast("array<string>")).alias("out"),
        )

    def nested(body_: Column) -> Column:
        pieces, tokens = pieces_and_tokens(body_, PARAM_MARKS)
        # A final bar of our own closes the last part.
        return let(
            F.struct(pieces.alias("p"), tokens.alias("t")),
            lambda cut: scan(
                F.concat(
                    F.arrays_zip(
                        F.slice(cut["p"], F.lit(1), F.size(cut["t"])).alias("gap"), cut["t"].alias("tok")
                    ),
                    F.array(F.struct(F.element_at(cut["p"], F.lit(-1)).alias("gap"), F.lit("|").alias("tok"))),
                ),
                F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")),
                step,
                "string",
            ),
        )

    return let(
        body,
        lambda b: F.when(matches(b, r"\{\{|\[\[|<"), nested(b)).otherwise(F.split(b, r"\|", -1)),
    )


# One parameter without nesting beyond one level: a name, then text in which links and templates count as one piece.
PARAM = (
    r"\|(?:\s*([^=|\[{<]*?)\s*=)?"
    r"((?:[^|\[{]++|\[\[[^\[\]]*+\]\]|\{\{[^{}]*+\}\}|[\[{])*+)"
)
_BEGIN, _VALUE = "\x1e", "\x1f"
_DEEP = (
    r"(?=[{<|\[])(?:\{\{[^}]*\{\{|\{\{\{|<!--|<(?i:nowiki|math|pre|ref|source|gallery)|\|\s*="
    r"|\[\[[^\]]*(?:\[\[|\{\{))"
)


def _numbered(parts: Column) -> Column:
    """`array<struct<pos,name,value,positional>>` from (named, name, value); unnamed ones are numbered from 1."""
    return F.transform(
        parts,
        lambda p, i: F.struct(
            (i + 1).alias("pos"),
            F.when(p["named"], p["name"])
            .otherwise(F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: ~q["named"])).cast("string"))
            .alias("name"),
            p["value"].alias("value"),
            (~p["named"]).alias("positional"),
        ),
    )


def _params_by_pattern(body: Column) -> Column:
    """Parameters of a body without deep nesting, read with one pattern.

    The pattern is run once: it marks where names and values begin, and the text is cut at the marks. A body that holds
    these control characters itself is read with one run for the names and one for the values.
    """

    def read(name: Column, value: Column) -> Column:
        return F.struct((name != "").alias("named"), name.alias("name"), trim_all(value).alias("value"))

    found = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(PARAM), F.lit(1)).alias("name"),
        F.regexp_extract_all(body, F.lit(PARAM), F.lit(2)).alias("value"),
    )
    marked = F.split(F.regexp_replace(body, PARAM, f"{_BEGIN}$1{_VALUE}$2"), _BEGIN, -1)
    cut = let(
        marked,
        lambda ps: F.transform(
            F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))),
            lambda p: read(F.substring_index(p, _VALUE, 1), F.substring_index(p, _VALUE, -1)),
        ),
    )
    return F.when(
        F.contains(body, F.lit(_BEGIN)) | F.contains(body, F.lit(_VALUE)),
        F.transform(found, lambda p: read(p["name"], p["value"])),
    ).otherwise(cut)


def _params_by_scan(body: Column) -> Column:
    """Parameters of any body: split at the bars of the top level, then at the first equal sign."""

    def read(part: Column) -> Column:
        def cut(at: Column) -> Column:
            name = trim_all(F.substring(part, F.lit(1), at - 1))
            named = (at > 0) & ~matches(name, r"[{\[<]")
            return F.struct(
                named.alias("named"),
                name.alias("name"),
                trim_all(F.when(named, F.substring(part, at + 1, F.length(part))).otherwise(part)).alias("value"),
            )

        return let(F.instr(part, F.lit("=")), cut)

    return let(
        _split_top_level(body),
        lambda pieces: F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), read),
    )


def template_params(template: ColumnOrName) -> Column:
    """`array<struct<pos,name,value,positional>>` of a template text; unnamed parameters are numbered from 1."""
    c = col(template)
    closed = F.when(c.endswith("}}"), F.length(c) - 4).otherwise(F.length(c) - 2)
    return let(
        F.substring(c, F.lit(3), closed),
        lambda body: let(
            F.when(matches(body, _DEEP), _params_by_scan(body)).otherwise(
                _params_by_pattern(F.substring(body, F.instr(body, F.lit("|")), F.length(body)))
            ),
            _numbered,
        ),
    )


def params_to_map(params: ColumnOrName) -> Column:
    """Name to value; where a name is given twice the last value wins."""

    def build(items: Column) -> Column:
        names = F.transform(items, lambda p: p["name"])
        last = F.filter(
            items,
            lambda p, i: ~F.exists(
                F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda q: q["name"] == p["name"]
            ),
        )
        kept = F.when(F.size(F.array_distinct(names)) == F.size(items), items).otherwise(last)
        return F.map_from_entries(
            F.transform(kept, lambda p: F.struct(p["name"].alias("k"), p["value"].alias("v")))
        )

    return let(col(params), build)


def has_param(params: ColumnOrName, name: str, ignore_empty: bool = False) -> Column:
    value = F.try_element_at(col(params), F.lit(name))
    return is_set(F.trim(value)) if ignore_empty else value.isNotNull()


def get_param(params: ColumnOrName, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(col(params), F.lit(name)), F.lit(default))


def set_param(params: ColumnOrName, name: str, value: Column) -> Column:
    """Parameter list with `name` set: the last occurrence is changed, or a new one is appended."""

    def change(items: Column) -> Column:
        last = F.array_max(F.transform(F.filter(items, lambda p: p["name"] == name), lambda p: p["pos"]))
        changed = F.transform(
            items,
            lambda p: F.when(
                p["pos"] == last,
                F.struct(
                    p["pos"].alias("pos"), p["name"].alias("name"), value.alias("value"),
                    p["positional"].alias("positional"),
                ),
            ).otherwise(p),
        )
        added = F.concat(
            items,
            F.array(
                F.struct(
                    (F.size(items) + 1).alias("pos"), F.lit(name).alias("name"), value.alias("value"),
                    F.lit(False).alias("positional"),
                )
            ),
        )
        return F.when(last.isNull(), added).otherwise(changed)

    return let(col(params), change)


def drop_param(params: ColumnOrName, name: str) -> Column:
    return F.filter(col(params), lambda p: p["name"] != name)


def template_text(name: ColumnOrName, params: ColumnOrName) -> Column:
    """Wikitext of a template from its name and parameter list."""
    body = F.transform(
        col(params),
        lambda p: F.when(p["positional"], p["value"]).otherwise(F.concat(p["name"], F.lit("="), p["value"])),
    )
    return F.concat(F.lit("{{"), F.array_join(F.concat(F.array(col(name)), body), "|"), F.lit("}}"))


# --- links -----------------------------------------------------------------------------------------------


def wikilinks(text: ColumnOrName) -> Column:
    """`array<struct<title,text>>` of `[[title|text]]`; `text` is null when absent."""
    raw = F.regexp_extract_all(col(text), F.lit(r"\[\[([^\[\]{}|<>\n]+(?:\|[^\[\]]*)?)\]\]"), F.lit(1))
    return F.transform(
        raw,
        lambda r: F.struct(
            F.regexp_extract(r, r"^([^|]*)", 1).alias("title"),
            F.when(F.contains(r, F.lit("|")), F.regexp_extract(r, r"(?s)^[^|]*\|(.*)$", 1)).alias("text"),
        ),
    )


_SCHEME = r"(?:(?:" + "|".join(SCHEMES_WITH_SLASHES) + r")://|(?:" + "|".join(SCHEMES_WITHOUT_SLASHES) + r"):(?://)?)"
_EXTERNAL = rf"(?i)\[(?:{_SCHEME}|//)[^\s\[\]<>\"]+[^\]\n]*\]|(?<![\w\[/]){_SCHEME}[^\s\[\]<>\"{{}}|]+"


def external_links(text: ColumnOrName) -> Column:
    """`array<struct<url,title,brackets>>` of `[url title]` and bare addresses with a known scheme."""

    def read(raw: Column) -> Column:
        brackets = raw.startswith("[")
        return F.struct(
            F.when(brackets, F.regexp_extract(raw, r"^\[([^\s\]]+)", 1))
            .otherwise(F.regexp_replace(raw, r"[,.;:!?)']+$", ""))
            .alias("url"),
            F.when(brackets & matches(raw, r"^\[\S+\s+[^\]]"), F.regexp_extract(raw, r"(?s)^\[\S+\s+(.*)\]$", 1)).alias(
                "title"
            ),
            brackets.alias("brackets"),
        )

    return F.transform(F.regexp_extract_all(col(text), F.lit(_EXTERNAL), F.lit(0)), read)


def valid_scheme(scheme: ColumnOrName, slashes: bool = True) -> Column:
    """Scheme allowed for links; without `//` only some are."""
    allowed = SCHEMES_WITHOUT_SLASHES + (SCHEMES_WITH_SLASHES if slashes else [])
    return F.coalesce(F.lower(col(scheme)).isin(*allowed), F.lit(False))


def page_title_key(title: ColumnOrName) -> Column:
    """Key under which loosely equal page names meet: markup off, `_` as blank, first letter upper."""
    plain = F.trim(F.translate(strip_code(title), "_", " "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))


def title_matches(a: ColumnOrName, *others: ColumnOrName | str) -> Column:
    """Loose equality of a page name with any of the others."""
    key = page_title_key(a)
    out = F.lit(False)
    for o in others:
        out = out | (key == page_title_key(o))
    return out


# --- headings, lists, tables -----------------------------------------------------------------------------

_HEADING = r"(?m)^(={1,6})([^\n]+?)\1[ \t]*$"


def headings(text: ColumnOrName) -> Column:
    """`array<struct<start,end,level,title>>`, positions count characters from 0."""
    pieces, tokens = pieces_and_tokens(col(text), _HEADING)
    item = "struct<start:int,end:int,level:int,title:string>"

    def step(pos: Column, part: Column) -> Column:
        token = part["tok"]
        start = pos + F.length(part["gap"])
        level = F.length(F.regexp_extract(token, _HEADING, 1))
        return F.struct(
            (start + F.length(token)).alias("state"),
            F.array(
                F.struct(
                    start.alias("start"),
                    (start + F.length(token)).alias("end"),
                    level.alias("level"),
                    F.regexp_extract(token, _HEADING, 2).alias("title"),
                )
            ).alias("out"),
        )

    return let(
        F.struct(pieces.alias("p"), tokens.alias("t")),
        lambda cut: scan(
            F.arrays_zip(F.slice(cut["p"], F.lit(1), F.size(cut["t"])).alias("gap"), cut["t"].alias("tok")),
            F.lit(0),
            step,
            item,
        ),
    )


def list_items(text: ColumnOrName) -> Column:
    """`array<struct<line,markers,tag,text>>` of lines that open with list markers."""
    lines = F.transform(F.split(col(text), "\n", -1), lambda s, i: F.struct(i.alias("line"), s.alias("raw")))
    marked = F.filter(lines, lambda s: matches(s["raw"], r"^[*#;:]"))

    def read(s: Column) -> Column:
        markers = F.regexp_extract(s["raw"], r"^([*#;:]+)", 1)
        return F.struct(
            (s["line"] + 1).alias("line"),
            markers.alias("markers"),
            lookup(LIST_TAGS, F.substring(markers, -1, 1)).alias("tag"),
            F.trim(F.regexp_replace(s["raw"], r"^[*#;:]+", "")).alias("text"),
        )

    return F.transform(marked, read)


def tables(text: ColumnOrName) -> Column:
    """Cells of all wiki tables: `array<struct<table_no,row_no,cell_no,header,text>>`, numbers from 1."""
    found = F.regexp_extract_all(col(text), F.lit(r"(?sm)^[ :]*\{\|(.*?)^\s*\|\}"), F.lit(1))

    def cells(row: Column, t: Column, r: Column) -> Column:
        lines = F.regexp_extract_all(row, F.lit(r"(?m)^\s*([|!][^\n+][^\n]*)$"), F.lit(1))

        def split_line(line: Column) -> Column:
            header = line.startswith("!")
            body = F.substr(line, F.lit(2))
            parts = F.when(header, F.split(body, r"!!|\|\|", -1)).otherwise(F.split(body, r"\|\|", -1))
            # `style | text`: attributes stand before a single bar.
            return F.transform(
                parts,
                lambda c: F.struct(
                    header.alias("header"), F.trim(F.regexp_replace(c, r"^[^|\[{]*\|(?!\|)", "")).alias("text")
                ),
            )

        return F.transform(
            F.flatten(F.transform(lines, split_line)),
            lambda c, i: F.struct(
                (t + 1).alias("table_no"),
                (r + 1).alias("row_no"),
                (i + 1).alias("cell_no"),
                c["header"].alias("header"),
                c["text"].alias("text"),
            ),
        )

    def rows(table: Column, t: Column) -> Column:
        # The first line holds the attributes of the table.
        body = F.regexp_replace(table, r"^[^\n]*", "")
        parts = F.filter(F.split(body, r"(?m)^\s*\|-[^\n]*$", -1), lambda p: matches(p, r"(?m)^\s*[|!][^\n+]"))
        return F.flatten(F.transform(parts, lambda p, r: cells(p, t, r)))

    return F.flatten(F.transform(found, rows))


# --- tags, comments, entities ----------------------------------------------------------------------------


def tags(text: ColumnOrName, tag: str) -> Column:
    """`array<struct<tag,attributes,contents,self_closing>>` of one HTML tag, not nested in itself."""
    name = tag.lower()
    if name in VOID_TAGS:
        pattern = rf"(?is)<{name}((?:\s[^<>]*?)?)(/?)>()"
        closed = False
    else:
        pattern = rf"(?is)<{name}((?:\s[^<>]*?)?)(?:(/)>|>(.*?)</{name}\s*>)"
        closed = True
        if name in SINGLE_TAGS:
            pattern = rf"(?is)<{name}((?:\s[^<>]*?)?)(?:(/)>|>(.*?)(?:</{name}\s*>|(?=<{name}[\s>])|(?=</(?:ul|ol|dl|table|tr)\b)|$))"
    raw = F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))

    def read(r: Column) -> Column:
        slash = F.regexp_extract(r, pattern, 2)
        return F.struct(
            F.lit(name).alias("tag"),
            F.trim(F.regexp_extract(r, pattern, 1)).alias("attributes"),
            F.when(F.lit(closed) & (slash == ""), F.regexp_extract(r, pattern, 3)).alias("contents"),
            (F.lit(not closed) | (slash == "/")).alias("self_closing"),
        )

    return F.transform(raw, read)


_ATTRIBUTE = r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>/]+)))?"


def tag_attributes(attributes: ColumnOrName) -> Column:
    """`array<struct<name,value,quotes>>`; a bare attribute has a null value."""
    raw = F.regexp_extract_all(col(attributes), F.lit(_ATTRIBUTE), F.lit(0))

    def read(r: Column) -> Column:
        quotes = F.when(matches(r, r"^[^=]*=\s*\""), '"').when(matches(r, r"^[^=]*=\s*'"), "'")
        value = F.concat(*[F.regexp_extract(r, _ATTRIBUTE, g) for g in (2, 3, 4)])
        return F.struct(
            F.regexp_extract(r, _ATTRIBUTE, 1).alias("name"),
            F.when(F.contains(r, F.lit("=")), value).alias("value"),
            quotes.alias("quotes"),
        )

    return F.transform(raw, read)


def has_attribute(attributes: ColumnOrName, name: str) -> Column:
    return F.exists(tag_attributes(attributes), lambda a: a["name"] == name)


def get_attribute(attributes: ColumnOrName, name: str) -> Column:
    """Value of the last attribute of that name."""
    return F.try_element_at(F.filter(tag_attributes(attributes), lambda a: a["name"] == name), F.lit(-1))["value"]


def comments(text: ColumnOrName) -> Column:
    """Contents of all `<!-- … -->`."""
    return F.regexp_extract_all(col(text), F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_NAMED_ENTITIES = {name: chr(cp) for name, cp in name2codepoint.items()}


def decode_entities(text: ColumnOrName) -> Column:
    """Named, decimal and hexadecimal character entities as characters; unknown ones stay."""
    c = col(text)

    def char(code_point: Column) -> Column:
        usable = (code_point > 0) & (code_point < 0x110000) & ~code_point.between(0xD800, 0xDFFF)
        return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32"))

    def decode(entity: Column) -> Column:
        body = F.substring(entity, 2, F.length(entity) - 2)
        number = F.when(matches(body, r"^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10)).otherwise(
            F.substring(body, 2, 8)
        )
        return F.coalesce(
            F.when(body.startswith("#"), let(number.try_cast("bigint"), char)).otherwise(
                lookup(_NAMED_ENTITIES, body)
            ),
            entity,
        )

    def rebuild(raw: Column) -> Column:
        pieces, tokens = pieces_and_tokens(raw, _ENTITY)
        return F.array_join(
            F.flatten(
                F.zip_with(
                    pieces, F.transform(tokens, decode), lambda p, t: F.array(p, F.coalesce(t, F.lit("")))
                )
            ),
            "",
        )

    return let(c, lambda v: F.when(F.contains(v, F.lit("&")), rebuild(v)).otherwise(v))


# --- plain text ------------------------------------------------------------------------------------------


def _until_gone(text: Column, marker: str, body) -> Column:
    """Apply `body` until it changes nothing more or `marker` has gone, whatever the depth.

    Every pass that changes a text removes one of its signs at least; texts without the marker cost one test.
    """
    def walk(c: Column) -> Column:
        most = F.length(c) - F.length(F.translate(c, "{|[", "")) + 1
        state = F.aggregate(
            F.sequence(F.lit(1), most),
            F.struct(c.alias("text"), F.lit(True).alias("open")),
            lambda acc, _: F.when(
                acc["open"] & F.contains(acc["text"], F.lit(marker)),
                let(body(acc["text"]), lambda new: F.struct(new.alias("text"), (new != acc["text"]).alias("open"))),
            ).otherwise(acc),
        )
        return F.when(F.contains(c, F.lit(marker)), state["text"]).otherwise(c)

    return let(text, walk)


def _drop_templates(text: Column, keep_params: bool) -> Column:
    def one_pass(c: Column) -> Column:
        c = F.regexp_replace(c, r"\{\{\{[^{}|]*\|([^{}]*)\}\}\}", "$1")
        c = F.regexp_replace(c, r"\{\{\{[^{}|]*\}\}\}", "")
        if keep_params:
            # Values only, set apart by blanks.
            c = F.regexp_replace(c, r"\{\{[^{}|]*\}\}", "")
            c = F.regexp_replace(c, r"\{\{[^{}|]*\|(?:[^{}|=]*=)?([^{}|]*)\}\}", "$1")
            return F.regexp_replace(c, r"(\{\{[^{}|]*)\|(?:[^{}|=]*=)?([^{}|]*)\|(?:[^{}|=]*=)?", "$1|$2 ")
        return F.regexp_replace(c, r"\{\{[^{}]*\}\}", "")

    return _until_gone(text, "{{", one_pass)


def _show_links(text: Column) -> Column:
    def one_pass(c: Column) -> Column:
        c = F.regexp_replace(c, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1")
        return F.regexp_replace(c, r"\[\[([^\[\]|]*)\]\]", "$1")

    return _until_gone(text, "[[", one_pass)


_MARKUP = "{}[]'=*#:;|!&"
_SHELTERED = "".join(chr(0xF700 + i) for i in range(len(_MARKUP)))
_VERBATIM = r"(?is)<(?:nowiki|pre|source|syntaxhighlight|hiero)(?:\s[^<>]*)?(?<!/)>.*?</(?:nowiki|pre|source|syntaxhighlight|hiero)\s*>"


def _shelter(c: Column) -> Column:
    """Put stand-ins for the markup signs inside verbatim tags, so that they come through as text."""

    def cut(raw: Column) -> Column:
        pieces, tokens = pieces_and_tokens(raw, _VERBATIM)
        hidden = F.transform(
            tokens, lambda t: F.translate(F.regexp_replace(t, r"^<[^<>]*>|<[^<>]*>$", ""), _MARKUP, _SHELTERED)
        )
        return F.array_join(
            F.flatten(F.zip_with(pieces, hidden, lambda p, t: F.array(p, F.coalesce(t, F.lit(""))))), ""
        )

    return F.when(matches(c, r"(?i)<(?:nowiki|pre|source|syntaxhighlight|hiero)\b"), cut(c)).otherwise(c)


def strip_code(
    text: ColumnOrName, normalize: bool = True, collapse: bool = True, keep_template_params: bool = False
) -> Column:
    """Readable text: no templates, comments or hidden tags; links and headings by their shown part."""
    def without_tags(c: Column) -> Column:
        hidden = r"(?is)<(" + "|".join(INVISIBLE_TAGS) + r")(?:\s[^<>]*)?(?<!/)>.*?</\1\s*>"
        shown = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), hidden, "")
        return F.when(
            F.contains(c, F.lit("<")), F.regexp_replace(shown, r"(?is)</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", "")
        ).otherwise(c)

    c = let(let(col(text), _shelter), without_tags)
    c = _drop_templates(c, keep_template_params)
    c = _show_links(c)
    c = F.regexp_replace(c, rf"(?i)\[(?:{_SCHEME}|//)[^\s\[\]]+\s+([^\]\n]*)\]", "$1")
    c = F.regexp_replace(c, rf"(?i)\[(?:{_SCHEME}|//)[^\s\[\]]+\]", "")
    c = F.regexp_replace(c, r"'{2,}", "")
    c = F.regexp_replace(c, r"(?m)^(={1,6})([^\n]+?)\1[ \t]*$", "$2")
    c = F.regexp_replace(c, r"(?m)^[*#:;]+", "")
    c = let(
        c,
        lambda v: F.when(
            F.contains(v, F.lit("{|")),
            F.regexp_replace(v, r"(?m)^(?:\{\||\|-|\|\+|\|\})[^\n]*$|^[|!]|\|\||!!", ""),
        ).otherwise(v),
    )
    if normalize:
        c = decode_entities(c)
    c = F.translate(c, _SHELTERED, _MARKUP)
    if collapse:
        c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return c


def strip_bound(value: Column) -> Column:
    """`strip_code` for a lambda variable or a plain column: most values hold no markup and stay as they are."""
    return F.when(matches(value, r"[\[{<&\n]|''|^[*#:;=]"), strip_code(value)).otherwise(value)


def strip_value(text: ColumnOrName) -> Column:
    """`strip_bound` for any expression, which is evaluated once."""
    return let(col(text), strip_bound)


def unlink(text: ColumnOrName) -> Column:
    """`[[page|shown]]` to `shown`, `[[page]]` to `page`."""
    c = F.regexp_replace(col(text), r"\[\[[^\[\]|]*\|\s*([^\[\]]*?)\s*\]\]", "$1")
    return F.regexp_replace(c, r"\[\[\s*([^\[\]]*?)\s*\]\]", "$1")


def strip_apostrophes(text: ColumnOrName) -> Column:
    """Drop bold and italic marks, two to five apostrophes."""
    return F.regexp_replace(col(text), r"'{2,}", "")
