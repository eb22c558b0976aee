"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    A column used inside a higher-order lambda would be computed again for every element; binding it as a
    lambda variable of its own keeps the work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_set(c: Column) -> Column:
    """True for a value that is neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_set(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def in_list(c: Column, values: Iterable[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """Null-safe regular expression test."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def any_of(*conds: Column) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def first_values(m: Column, names: Iterable[Iterable[str]]) -> Column:
    """For each list of names the first one's value that a map holds, as an array."""
    table = F.array(*[F.split(F.lit("|".join(group)), r"\|") for group in names])
    return F.transform(
        table,
        lambda group: F.get(
            F.filter(F.transform(group, lambda n: F.try_element_at(m, n)), lambda v: v.isNotNull()), F.lit(0)
        ),
    )


_ENTRY, _PAIR = "\x1e", "\x1f"


def literal_map(table: Mapping[str, object]) -> Column:
    """Constant `map<string,string>` of a small fixed table, written as one foldable expression."""
    text = _ENTRY.join(f"{k}{_PAIR}{v}" for k, v in table.items())
    return F.str_to_map(F.lit(text), F.lit(_ENTRY), F.lit(_PAIR))


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of `key` in a small fixed table, null when absent."""
    value = F.try_element_at(literal_map(table), key)
    return value.cast("int") if all(isinstance(v, int) for v in table.values()) else value


def trim_all(c: Column) -> Column:
    """Trim blanks, tabs and line ends."""
    return F.trim(c, F.lit(" \t\r\n"))


def pieces_and_tokens(text: Column, pattern: str) -> tuple[Column, Column]:
    """Text between matches (n + 1 entries) and the matches (n entries)."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def scan(
    items: Column,
    init: Column,
    step: Callable[[Column, Column], Column],
    out_type: str,
    chunk: int = 64,
) -> Column:
    """Walk `items` with a running state and gather what each step emits.

    `step(state, item)` returns `struct(state, out)`, `out` being an array of `out_type`. Appending to one long
    array copies it at every step, so items are walked in chunks and the chunks are joined at the end: cost
    grows with n * chunk and not with n * n.
    """
    none = F.array().cast(f"array<{out_type}>")
    chunks = F.when(
        F.size(items) > 0,
        let(
            items,
            lambda all_items: F.transform(
                F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / chunk).cast("int")),
                lambda k: F.slice(all_items, k * chunk + 1, F.lit(chunk)),
            ),
        ),
    ).otherwise(F.array(F.slice(items, F.lit(1), F.lit(0))))

    def inner(acc: Column, item: Column) -> Column:
        return let(
            step(acc["state"], item),
            lambda r: F.struct(
                r["state"].alias("state"),
                F.when(F.size(r["out"]) > 0, F.concat(acc["out"], r["out"])).otherwise(acc["out"]).alias("out"),
            ),
        )

    def outer(acc: Column, part: Column) -> Column:
        return let(
            F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), inner),
            lambda r: F.struct(
                r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")
            ),
        )

    start = F.struct(init.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("outs"))
    return F.aggregate(chunks, start, outer, lambda acc: F.flatten(acc["outs"]))


def cut_runs(items: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """Cut an array into runs of neighbours: `opens(item, one before)` tells where a new run begins.

    Linear in the array; the first item always begins a run, an empty array has none.
    """

    def cut(xs: Column) -> Column:
        begins = F.filter(
            F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | opens(F.get(xs, i), F.get(xs, F.greatest(i - 1, F.lit(0))))
        )
        return let(
            begins,
            lambda bs: F.transform(
                bs, lambda b, k: F.slice(xs, b + 1, F.coalesce(F.get(bs, k + 1), F.size(xs)) - b)
            ),
        )

    # An empty array gives an empty list of the same type.
    return let(items, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(F.slice(F.array(xs), F.lit(2), F.lit(1))))


def substrings(text: Column, bounds: Column, chunk: int = 128) -> Column:
    """Pieces of a text between ordered places, `array<struct<start,end>>`, counted in characters from 0.

    Finding a character means walking there from the front of the text, so pieces are taken out of blocks of `chunk`
    neighbours, and only blocks out of the whole text.
    """

    def block(part: Column) -> Column:
        first = F.get(part, F.lit(0))["start"]
        return let(
            F.substring(text, first + 1, F.element_at(part, -1)["end"] - first),
            lambda t: F.transform(part, lambda b: F.substring(t, b["start"] - first + 1, b["end"] - b["start"])),
        )

    return let(
        bounds,
        lambda bs: F.flatten(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.floor(F.size(bs) / chunk).cast("int")), lambda k: k * chunk < F.size(bs)),
                lambda k: let(F.slice(bs, k * chunk + 1, F.lit(chunk)), block),
            )
        ),
    )


def settle(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Pass costly columns through a generator, one row in and one row out.

    A filter above a projection is moved below it with every column reference replaced by its expression; for
    expressions that build on each other the copies multiply. Generator output stops that: a filter stays above,
    and each expression is evaluated once per row.
    """
    made = list(columns)
    keep = [c for c in df.columns if c not in made]
    return df.select(*keep, F.inline(F.array(F.struct(*made))))


def unfused(c: Column) -> Column:
    """The same value by a lambda, which keeps its projection out of whole-stage code: a projection of very many expressions
    makes one method there that is too long for the JVM to compile, and is cut into many outside."""
    return let(c, lambda x: x)


def join_key(cond: Column, key: Column, *spread_by: ColumnOrName) -> Column:
    """Join key for the rows under `cond`; the others get one of many keys that match nothing.

    A null key would send all of them to the same task in a shuffled outer join.
    """
    other = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*[col(c) for c in spread_by]), F.lit(4096)).cast("string"))
    return F.when(cond, key).otherwise(other)
