"""Template and argument spans of wikitext, found inside the row: no shuffle.

Spans are found by one walk over the runs of braces in an Arrow function; what is done with them is Spark expressions.
A fold with a stack in built-in functions copies its state at every run and took a millisecond a page.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StructType

from refloom.functions.core import ColumnOrName, col, let, scan
from refloom.tables.markup import OPAQUE_TAGS

OPAQUE_PATTERN = r"<!--.*?-->|<(?:" + "|".join(
    rf"{t}(?:\s[^<>]*)?(?<!/)>.*?</{t}" for t in OPAQUE_TAGS
) + r")\s*>"
# The look-ahead rules out most characters before the alternatives are tried.
BRACE_RUNS = r"(?is)(?=[<{}])(?:" + OPAQUE_PATTERN + r"|\{{2,}|\}{2,})"

_SPAN = StructType().add("start", "integer").add("end", "integer").add("kind", "string").add("text", "string")


def span_walk():
    """(text) -> [(start, end, kind)] of all spans by start. All it needs is made inside it, so it travels to workers that
    do not have this package."""
    # `re` with this flag reads blanks and letter case as a Java pattern does.
    runs = re.compile(BRACE_RUNS, re.ASCII)

    def spans(text: str) -> list[tuple[int, int, str]]:
        """A stack holds the open runs as [place, braces left]; a closing run pairs with the innermost open run, three
        braces at a time for arguments and two for templates."""
        found, stack = [], []
        for run in runs.finditer(text):
            at, end = run.span()
            if text[at] == "{":
                stack.append([at, end - at])
            elif text[at] == "}":
                while stack and end - at >= 2:
                    top = stack[-1]
                    width = 3 if top[1] >= 3 and end - at >= 3 else 2
                    top[1] -= width
                    at += width
                    found.append((top[0] + top[1], at, "argument" if width == 3 else "template"))
                    if top[1] < 2:
                        stack.pop()
        # Every opening brace is used once, so no two spans start at the same place.
        return sorted(found)

    return spans


def _span_finder():
    """The Arrow function behind `brace_spans`."""
    spans = span_walk()

    def found_spans(texts: pa.Array) -> pa.Array:
        starts, ends, kinds, parts, offsets = [], [], [], [], []
        for raw in texts.cast(pa.binary()).to_pylist():
            offsets.append(None if raw is None else len(starts))
            # Broken bytes are read as a Java string reads them.
            text = "" if raw is None else raw.decode("utf-8", "replace")
            for start, end, kind in spans(text):
                starts.append(start)
                ends.append(end)
                kinds.append(kind)
                parts.append(text[start:end])
        offsets.append(len(starts))
        numbers = [pa.array(v, pa.int32()) for v in (starts, ends)]
        texts_ = [pa.array(v, pa.string()) for v in (kinds, parts)]
        items = pa.StructArray.from_arrays([*numbers, *texts_], ["start", "end", "kind", "text"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    return arrow_udf(found_spans, ArrayType(_SPAN))


_found_spans = _span_finder()


def brace_spans(text: ColumnOrName) -> Column:
    """`array<struct<start,end,kind,text>>` of all closed `{{…}}` and `{{{…}}}`, outer before nested.

    `start` counts characters from 0, `end` is exclusive. Comments and tags with opaque content are skipped,
    stray or unclosed braces are plain text. Not for use inside a lambda, as the spans are found in a Python worker.
    """
    return _found_spans(col(text))


def template_spans(text: ColumnOrName) -> Column:
    """The templates among `brace_spans`."""
    return F.filter(brace_spans(text), lambda s: s["kind"] == "template")


def argument_spans(text: ColumnOrName) -> Column:
    """The `{{{name|default}}}` arguments among `brace_spans`."""
    return F.filter(brace_spans(text), lambda s: s["kind"] == "argument")


def outermost(spans: Column) -> Column:
    """Spans that no earlier span covers (input sorted by start)."""
    item = "struct<start:int,end:int,kind:string,text:string>"

    def step(reach: Column, s: Column) -> Column:
        free = s["start"] >= reach
        return F.struct(
            F.when(free, s["end"]).otherwise(reach).alias("state"),
            F.when(free, F.array(s)).otherwise(F.array().cast(f"array<{item}>")).alias("out"),
        )

    return scan(spans, F.lit(-1), step, item)


def with_ancestors(spans: Column) -> Column:
    """Add `depth` (from 1) and `ancestors` (starts of the enclosing spans, shallow to deep)."""
    item = "struct<start:int,end:int,kind:string,text:string,depth:int,ancestors:array<int>>"

    def step(opened: Column, s: Column) -> Column:
        return let(
            F.filter(opened, lambda o: o["end"] > s["start"]),
            lambda above: F.struct(
                F.concat(above, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("state"),
                F.array(
                    F.struct(
                        s["start"].alias("start"),
                        s["end"].alias("end"),
                        s["kind"].alias("kind"),
                        s["text"].alias("text"),
                        (F.size(above) + 1).alias("depth"),
                        F.transform(above, lambda o: o["start"]).alias("ancestors"),
                    )
                ).alias("out"),
            ),
        )

    return scan(spans, F.array().cast("array<struct<start:int,end:int>>"), step, item)


def balanced(text: ColumnOrName) -> Column:
    """True when the curly braces of the text cancel out, everything else ignored."""

    def counted(only: Column) -> Column:
        return F.aggregate(
            F.split(only, ""),
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
            lambda acc, c: let(
                acc["depth"] + F.when(c == "{", 1).otherwise(-1),
                lambda d: F.struct(d.alias("depth"), F.least(acc["low"], d).alias("low")),
            ),
            lambda acc: (acc["depth"] == 0) & (acc["low"] >= 0),
        )

    return let(
        F.regexp_replace(col(text), r"[^{}]+", ""),
        lambda only: F.when(only.isin("", "{{}}", "{{{{}}}}"), True)
        .when(only == "{{", False)
        .otherwise(counted(only)),
    )


def repair_unbalanced(text: ColumnOrName) -> Column:
    """Close a citation that lost its closing braces."""
    return let(col(text), lambda c: F.when(balanced(c), c).otherwise(F.concat(c, F.lit("}}"))))
