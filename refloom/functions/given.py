"""What the set parameters of a citation amount to: fields, identifiers, people, kinds of names.

The rules of `citation.field_values`, `identifiers.extract_ids`, `quality.param_status`, `quality.name_list` and
`names.authors` in one Arrow function: each name is looked up once, where the expressions search the whole map for every
name of their tables.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructType

from refloom.functions.core import ColumnOrName, col
from refloom.functions.names import AND_OTHERS, ET_AL, person_codes
from refloom.tables.params import DEPRECATED, FIELD_ALIASES, ID_KINDS, KNOWN_PARAMS, NAME_LISTS, NUMBERED_PARAMS

_TEXTS = ArrayType(StringType())
_LIST = (
    StructType().add("lasts", _TEXTS).add("names", _TEXTS).add("links", _TEXTS)
    .add("first_alone", BooleanType()).add("hole", BooleanType())
)
_PEOPLE = ArrayType(StructType().add("last", "string").add("first", "string").add("link", "string").add("mask", "string"))

# A Java `$` is also before a last line end of any kind, and a Java point is no line end.
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_POINT = r"[^\n\r\x85\u2028\u2029]"

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def field_reader(fields: Iterable[str]):
    """(set parameters) -> values of the fields, None where no parameter sets one."""
    return _first_values([FIELD_ALIASES[f] for f in fields])


def _first_values(groups: list[list[str]]):
    places: dict[str, list[tuple[int, int]]] = {}
    for i, names in enumerate(groups):
        for rank, name in enumerate(names):
            places.setdefault(name, []).append((i, rank))
    size, none = len(groups), 1 << 30

    def values(given: dict[str, str]) -> list[str | None]:
        out, ranks = [None] * size, [none] * size
        for name, value in given.items():
            for i, rank in places.get(name, ()):
                if rank < ranks[i]:
                    out[i], ranks[i] = value, rank
        return out

    return values


def alias_groups() -> dict[str, list[str]]:
    """Fields and identifier kinds that several parameters can fill, one of which is enough."""
    fields = {f: names for f, names in FIELD_ALIASES.items() if len(names) > 1 and f not in ("Date", "Encyclopedia")}
    return fields | {k: names for k, (names, _) in ID_KINDS.items() if len(names) > 1}


def twice_reader():
    """(set parameters) -> some field is set by two parameters or more."""
    groups: dict[str, list[int]] = {}
    for i, names in enumerate(alias_groups().values()):
        for name in names:
            groups.setdefault(name, []).append(i)

    def twice(given: dict[str, str]) -> bool:
        met = [i for name in given for i in groups.get(name, ())]
        return len(set(met)) < len(met)

    return twice


def id_reader():
    """(set parameters) -> identifiers by kind, kinds in alphabetic order."""
    kinds, values = list(ID_KINDS), _first_values([names for names, _ in ID_KINDS.values()])

    def ids(given: dict[str, str]) -> dict[str, str]:
        return {k: v for k, v in zip(kinds, values(given), strict=True) if v is not None}

    return ids


def status_reader():
    """(name, value) -> the kind of a parameter that `quality.param_status` names."""
    deprecated, known, numbered = frozenset(DEPRECATED), frozenset(KNOWN_PARAMS), frozenset(NUMBERED_PARAMS)
    digits, number = re.compile(r"\d+", re.ASCII), re.compile(r"\d+" + _END, re.ASCII)

    def status(name: str, value: str) -> str:
        if name in deprecated:
            return "deprecated"
        general = digits.sub("#", name)
        if name in known or general in numbered:
            return "known"
        if number.match(name):
            return "text" if value.strip(" ") else "known"
        return "suggest" if name.lower() in known or general.lower() in numbered else "unknown"

    return status


def list_reader(kind: str):
    """(entries as (name without number, number, value)) -> (lasts, names, links, first_alone, hole) of one kind of people."""
    part_of = {}
    for part in ("last", "first", "link"):
        for name in NAME_LISTS[kind][part]:
            part_of[name.replace("#", "")] = part

    def people(entries: list[tuple[str, int, str]]):
        found: dict[tuple[int, str], str] = {}
        size = 0
        for name, no, value in entries:
            part = part_of.get(name)
            if part:
                size += 1
                found.setdefault((no, part), value)
        lasts, names, links, first_alone, hole, missing = [], [], [], False, False, 0
        for no in range(1, 2 * size + 3 if size else 1):
            if missing >= 2:
                break
            last, first = found.get((no, "last")), found.get((no, "first"))
            if last is not None:
                hole = hole or missing == 1
                missing = 0
                lasts.append(last)
                names.append(last)
                link = found.get((no, "link"))
                if link is not None:
                    links.append(link)
            elif first is None:
                missing += 1
            else:
                first_alone = True
            if first is not None:
                names.append(first)
        return lasts, names, links, first_alone, hole

    return people, frozenset(part_of)


def entry_reader(names: frozenset[str]):
    """(set parameters) -> those of people as (name without number, number, value); a bare name is number 1."""
    digits = re.compile(r"\d+", re.ASCII)

    def entries(given: dict[str, str]) -> list[tuple[str, int, str]]:
        out = []
        for key, value in given.items():
            number = digits.search(key)
            name = digits.sub("", key) if number else key
            if name in names:
                no = int(number.group()) if number else 1
                out.append((name, no if no < 1 << 31 else 0, value))
        return out

    return entries


def stripper():
    """(text) -> text without a closing `et al.`, or without `and others`."""
    may = re.compile("al|others", re.ASCII | re.IGNORECASE)
    et_al, others = re.compile(ET_AL.replace("$", _END)), re.compile(AND_OTHERS)

    def strip(text: str | None) -> str | None:
        if text is None or not may.search(text):
            return text
        return et_al.sub("", text) if et_al.search(text) else others.sub("", text)

    return strip


def people_reader(kind: str):
    """(set parameters) -> numbered people as (last, first, link, mask), as `names.people` reads them."""
    codes, strip, digits = person_codes(kind), stripper(), re.compile(r"[0-9]+")

    def people(given: dict[str, str]) -> list[tuple]:
        found = []
        for key, value in given.items():
            code = codes.get(digits.sub("#", key))
            if code is not None:
                number = digits.search(key)
                no = int(number.group()) if number else 1
                found.append((no if no < 1 << 31 else 1, code, value))
        if not found:
            return []
        by_number: dict[int, dict[str, str]] = {}
        for no, code, value in sorted(found):
            by_number.setdefault(no, {}).setdefault(code[0], value)
        at, gaps, out = 0, 0, []
        for no, parts in by_number.items():
            if "l" not in parts and "f" not in parts:
                continue
            # Numbers that are not there count as gaps; two in a row end the list for good.
            gaps += no - at - 1
            at = no
            if gaps >= 2:
                break
            if "l" in parts:
                gaps = 0
                out.append((strip(parts["l"]), strip(parts.get("f")), parts.get("k"), parts.get("m")))
        return out

    return people


def author_reader(kind: str = "author"):
    """(set parameters) -> people from the winning source, as `names.authors` reads them without free text."""
    usable = [n.replace("#", no) for n in NAME_LISTS[kind]["last"] for no in ("", "1", "2")]
    vanc = {"author": "vauthors", "editor": "veditors"}.get(kind)
    numbered, strip = people_reader(kind), stripper()
    comma, space = re.compile(r"\s*,\s*", re.ASCII), re.compile(r"\s", re.ASCII)
    corporate = re.compile(rf"\(\(({_POINT}+)\)\)" + _END)
    before, after = re.compile(rf"({_POINT}*)\s\S*" + _END, re.ASCII), re.compile(r"\s(\S*)" + _END, re.ASCII)

    def one(name: str) -> tuple:
        if found := corporate.match(name):
            return found.group(1), "", None, None
        if not space.search(name):
            return name, "", None, None
        head, tail = before.match(name), after.search(name)
        return space.sub(" ", head.group(1)) if head else "", tail.group(1) if tail else "", None, None

    def people(given: dict[str, str]) -> list[tuple]:
        if any(n in given for n in usable):
            return numbered(given)
        if vanc and vanc in given:
            return [one(name) for name in comma.split(strip(given[vanc]).strip(" "))]
        return []

    return people


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def _lists(rows: list, inner=_strings) -> pa.Array:
    """An Arrow list array of Python lists, None for a null list."""
    offsets, flat = [], []
    for row in rows:
        offsets.append(None if row is None else len(flat))
        if row:
            flat.extend(row)
    return pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), inner(flat))


def _people_array(rows: list) -> pa.Array:
    parts = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.StructArray.from_arrays([_strings(list(p)) for p in parts], ["last", "first", "link", "mask"])


def _maps(rows: list[dict]) -> pa.Array:
    offsets, names, values = [0], [], []
    for row in rows:
        names.extend(row)
        values.extend(row.values())
        offsets.append(len(names))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), _strings(names), _strings(values))


def _plain(texts: pa.Array) -> list:
    """Strings of a column; broken bytes are read as a Java string reads them."""
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()]


def _given_rows(params: pa.MapArray) -> list[dict[str, str] | None]:
    """For each row its parameters that hold something, None for a null map."""
    keys, items, at = _plain(params.keys), _plain(params.items), params.offsets.to_pylist()
    null = params.is_null().to_pylist()
    return [
        None if null[i] else {k: v for k, v in zip(keys[at[i] : at[i + 1]], items[at[i] : at[i + 1]], strict=True) if v}
        for i in range(len(params))
    ]


def given_parts(params: ColumnOrName, fields: Iterable[str], people: bool = False, checks: bool = False) -> Column:
    """`struct<values,ids>` of a parameter map: the fields in the order given, and the identifiers.

    `people` adds `authors` and `contributors`, `checks` adds `status` (kinds of the set parameters in their order),
    `twice` (a field is set by two of them) and `list_<kind>`. Empty parameters count as not given. Not for use inside a lambda, as maps are read in a Python worker.
    """
    wanted = list(fields)
    values, ids, status, twice = field_reader(wanted), id_reader(), status_reader(), twice_reader()
    authors, contributors = author_reader("author"), people_reader("contributor")
    readers = {kind: list_reader(kind) for kind in NAME_LISTS}
    entries = entry_reader(frozenset().union(*[names for _, names in readers.values()]))
    kind_of = StructType().add("values", _TEXTS).add("ids", MapType(StringType(), StringType()))
    if people:
        kind_of = kind_of.add("authors", _PEOPLE).add("contributors", _PEOPLE)
    if checks:
        kind_of = kind_of.add("status", _TEXTS).add("twice", BooleanType())
        for kind in NAME_LISTS:
            kind_of = kind_of.add(f"list_{kind}", _LIST)

    def columns(maps: pa.Array) -> pa.Array:
        rows = _given_rows(maps)
        known = [row or {} for row in rows]
        out = {"values": _lists([values(row) for row in known]), "ids": _maps([ids(row) for row in known])}
        if people:
            out["authors"] = _lists([authors(row) for row in known], _people_array)
            out["contributors"] = _lists([contributors(row) for row in known], _people_array)
        if checks:
            out["status"] = _lists([None if row is None else [status(k, v) for k, v in row.items()] for row in rows])
            out["twice"] = pa.array([twice(row) for row in known], pa.bool_())
            met = [entries(row) for row in known]
            for kind, (reader, _) in readers.items():
                parts = [*zip(*[reader(e) for e in met], strict=True)] or [[]] * 5
                arrays = [_lists(list(p)) for p in parts[:3]] + [pa.array(list(p), pa.bool_()) for p in parts[3:]]
                out[f"list_{kind}"] = pa.StructArray.from_arrays(arrays, ["lasts", "names", "links", "first_alone", "hole"])
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    return arrow_udf(columns, kind_of)(col(params))
