"""One walk over a citation text: closing braces, first template, its name and its parameters.

The same rules as `braces.repair_unbalanced`, `braces.template_spans`, `wikitext.template_name`, `wikitext.template_params`
and `wikitext.params_to_map` one after the other, in one Arrow function: as expressions they are folds and lambdas that
Spark interprets, at some 140 microseconds a citation.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import MapType, StringType, StructType

from refloom.functions.braces import span_walk
from refloom.functions.core import ColumnOrName, col
from refloom.functions.wikitext import PARAM, PARAM_MARKS

_READ = StructType().add("template", "string").add("name", "string").add("params", MapType(StringType(), StringType()))


def text_reader():
    """(text) -> (template, name, parameters by name in order), None for each that is not there. All it needs is made inside
    it, so it travels to workers that do not have this package."""
    spans = span_walk()
    # `re.ASCII` reads blanks and letter case as a Java pattern does; `$` is also before a last line end of any kind.
    end = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
    alone = re.compile(r"(?s)\{\{[^{}].*\}\}" + end)
    named = re.compile(r"(?s)\{\{(.*?)(?:\||\}\}" + end + ")")
    comment, blanks, braces = re.compile(r"(?s)<!--.*?-->"), re.compile(r"\s+", re.ASCII), re.compile(r"[{}]+")
    # The alternatives of `wikitext._DEEP`, each with the sign that it begins with.
    deep = [
        ("{{", re.compile(r"\{\{(?:\{|[^}]*\{\{)")),
        ("<", re.compile(r"<(?:!--|(?i:nowiki|math|pre|ref|source|gallery))", re.ASCII)),
        ("[[", re.compile(r"\[\[[^\]]*(?:\[\[|\{\{)")),
        ("|", re.compile(r"\|\s*=", re.ASCII)),
    ]
    param, marks = re.compile(PARAM, re.ASCII), re.compile(PARAM_MARKS, re.ASCII)
    in_name, in_nested = re.compile(r"[{\[<]"), re.compile(r"\{\{|\[\[|<")
    ends, space = " \t\r\n", " \t\n\x0b\x0c\r"

    def balanced(text: str) -> bool:
        if text.count("{") != text.count("}"):
            return False
        if text.rfind("{") <= text.find("}"):
            return True
        depth = 0
        for run in braces.finditer(text):
            for sign in run.group():
                depth += 1 if sign == "{" else -1
                if depth < 0:
                    return False
        return True

    def top_level(body: str) -> list[str]:
        """Split at bars outside nested templates, links, comments and opaque tags."""
        if not in_nested.search(body):
            return body.split("|")
        parts, held, depth, at = [], [], 0, 0
        for mark in marks.finditer(body):
            token = mark.group()
            held.append(body[at : mark.start()])
            at = mark.end()
            if token == "|" and depth == 0:
                parts.append("".join(held))
                held = []
                continue
            held.append(token)
            if token[0] == "{":
                depth += len(token)
            elif token[0] == "}":
                depth = max(0, depth - len(token))
            elif token == "[[":
                depth += 2
            elif token == "]]":
                depth = max(0, depth - 2)
        # A part that is not closed again is no parameter.
        return [*parts, "".join([*held, body[at:]])] if depth == 0 else parts

    def by_scan(body: str):
        for part in top_level(body)[1:]:
            at = part.find("=")
            name = part[: max(at, 0)].strip(ends)
            if at >= 0 and not in_name.search(name):
                yield name, part[at + 1 :].strip(ends)
            else:
                yield None, part.strip(ends)

    def by_pattern(body: str):
        if "[" in body or "{" in body:
            for found in param.finditer(body, max(body.find("|"), 0)):
                yield found.group(1) or None, found.group(2).strip(ends)
            return
        for part in body.split("|")[1:]:
            name, equal, value = part.partition("=")
            if equal and "<" not in name:
                yield name.strip(space), value.strip(ends)
            else:
                yield None, part.strip(ends)

    def parameters(template: str) -> dict[str, str]:
        body = template[2 : len(template) - 2 * template.endswith("}}")]
        scanned = any(sign in body and pattern.search(body) for sign, pattern in deep)
        found: dict[str, str] = {}
        unnamed = 0
        for name, value in by_scan(body) if scanned else by_pattern(body):
            if name is None:
                unnamed += 1
                name = str(unnamed)
            # The last value of a name wins, in its own place.
            found.pop(name, None)
            found[name] = value
        return found

    def read(text: str) -> tuple[str | None, str | None, dict[str, str] | None]:
        if not balanced(text):
            text += "}}"
        if text.find("{{", 1) < 0 and "<!--" not in text and "<nowiki" not in text and alone.match(text):
            template = text
        else:
            template = next((text[start:stop] for start, stop, kind in spans(text) if kind == "template"), None)
        if template is None:
            return None, None, None
        head = named.match(template)
        name = head.group(1) if head else ""
        if "<!--" in name:
            name = comment.sub("", name)
        return template, blanks.sub(" ", name.strip(ends)), parameters(template)

    return read


def _reader():
    read = text_reader()

    def columns(texts: pa.Array) -> pa.Array:
        templates, titles, names, values, offsets = [], [], [], [], []
        for raw in texts.cast(pa.binary()).to_pylist():
            # Broken bytes are read as a Java string reads them.
            template, title, params = (None, None, None) if raw is None else read(raw.decode("utf-8", "replace"))
            templates.append(template)
            titles.append(title)
            offsets.append(None if params is None else len(names))
            if params:
                names.extend(params)
                values.extend(params.values())
        offsets.append(len(names))
        strings = [pa.array(v, pa.string()) for v in (templates, titles, names, values)]
        params = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), strings[2], strings[3])
        return pa.StructArray.from_arrays([strings[0], strings[1], params], ["template", "name", "params"])

    return arrow_udf(columns, _READ)


_read = _reader()


def read_template(text: ColumnOrName) -> Column:
    """`struct<template,name,params>` of a citation text, its fields null where it holds no template.

    Not for use inside a lambda, as texts are read in a Python worker.
    """
    return _read(col(text))
