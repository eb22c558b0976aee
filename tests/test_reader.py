"""The one-walk readers against the expressions whose rules they follow."""

import random

from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions import citation as C
from refloom.functions import dates as D
from refloom.functions import identifiers as I
from refloom.functions import names as N
from refloom.functions import wikitext as W
from refloom.functions.core import matches
from refloom.functions.fields import any_invisible, invisible_chars
from refloom.functions.given import given_parts
from refloom.functions.reader import read_template
from refloom.operators import citations as O
from refloom.operators import quality as Q
from refloom.tables.params import FIELD_ALIASES, ID_KINDS, NAME_LISTS, NUMBERED_PARAMS

BITS = [
    "{{", "}}", "{", "}", "{{{", "}}}", "[[", "]]", "[", "|", "|", "=", " = ", "title", "a", "1", "<!--", "-->", "<nowiki>",
    "</nowiki>", "<ref name=x>", "</ref>", "\n", "\r\n", "\r", "\t", " ", "\x0b", " ", "\x85", "é", "😀", "\x1e", "\x1f",
    "|=", "| =", "<", "|a=", "{{lang|fr|x}}", "[[T|t]]", "\\", "$", "\xa0",
]


def odd_texts(n, seed=7):
    r = random.Random(seed)
    frames = ["{{{{cite book|{}}}}}", "{{{{cite web{}}}}}\n", "{{{{{}", "{}"]
    return [None, ""] + [r.choice(frames).format("".join(r.choices(BITS, k=r.randint(0, 12)))) for _ in range(n)]


def by_expressions(df):
    """The steps of the parse as they were: repair, first template, name, parameters."""
    text = F.col("_text")
    single = ~matches(text, r"(?s)^.+\{\{|<!--|<nowiki") & matches(text, r"(?s)^\{\{[^{}].*\}\}$")
    first = F.try_element_at(B.template_spans(F.when(~single, text)), F.lit(1))["text"]
    return (
        df.withColumn("_text", B.repair_unbalanced("text"))
        .withColumn("template", F.when(single, text).otherwise(first))
        .withColumn("name", W.template_name("template"))
        .withColumn("params", W.params_to_map(W.template_params("template")))
    )


def test_reader_follows_the_expressions(spark):
    rows = spark.createDataFrame(list(enumerate(odd_texts(1500))), "i int, text string")
    shown = ["i", "template", "name", F.map_entries("params").alias("p")]
    was = by_expressions(rows).select(*shown).collect()
    now = rows.withColumn("r", read_template("text")).select("i", "r.*").select(*shown).collect()
    assert sorted(was) == sorted(now)
    assert sum(x.template is None for x in now) > 50 and sum(bool(x.p) for x in now) > 500


def test_parse_is_one_walk(spark):
    """The parse as folds that Spark interprets took 140 microseconds a citation."""
    plan = O.parse_templates(spark.range(1).select(F.lit("{{cite book|a=1}}").alias("c")), "c")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "aggregate(" not in text
    assert plan.first().params == {"a": "1"}


NAMES = sorted(
    {n.replace("#", no) for n in NUMBERED_PARAMS for no in ("", "1", "2", "3", "6", "07", "99999999999")}
    | {n for names in FIELD_ALIASES.values() for n in names} | {n for names, _ in ID_KINDS.values() for n in names}
    | {"1", "2", "12", "1\r", "foo", "Title", "AUTHOR2", "Coauthors", "distributor", "İn", "x3y4", ""}
)
PERSONS = ["author", "last", "first", "vauthors", "authorlink", "contributor", "editor", "translator", "author-mask"]
VALUES = [
    "", " ", "a", "b", "Doe et al.", "Doe, et al", "X and others", "etal", "A B, C DE,((Corp )), E  F", "al", "\n", "A\rB C",
    "((x)) y", "((x))\n", ",", "J. K", "é F",
]


def odd_maps(n, seed=11):
    r = random.Random(seed)
    some = [x for x in NAMES if x.rstrip("0123456789") in PERSONS]
    maps = [{r.choice(some if r.random() < 0.7 else NAMES): r.choice(VALUES) for _ in range(r.randint(0, 9))} for _ in range(n)]
    return [None, {}, {"title": None}, *maps]


def test_given_parts_follow_the_expressions(spark):
    rows = spark.createDataFrame(list(enumerate(odd_maps(3000))), "i int, m map<string,string>")
    fields = list(FIELD_ALIASES)
    given = rows.withColumn("g", C.set_params("m"))
    parts = ["lasts", "names", "links", "first_alone", "hole"]
    was = given.select(
        "i",
        C.field_values("g", fields).alias("values"),
        F.map_entries(I.extract_ids("m")).alias("ids"),
        N.authors("g").alias("authors"),
        F.when(F.col("g").isNotNull(), N.people("g", "contributor")).alias("contributors"),
        F.transform(F.map_entries("g"), lambda e: Q.param_status(e["key"], e["value"])).alias("status"),
        Q._one_field_twice(F.col("g")).alias("twice"),
        *[F.struct(*[Q.name_list(F.col("g"), k)[p].alias(p) for p in parts]).alias(f"list_{k}") for k in NAME_LISTS],
    )
    now = rows.select("i", given_parts("m", fields, people=True, checks=True).alias("p")).select("i", "p.*")
    now = now.withColumn("ids", F.map_entries("ids"))
    a, b = ({x.i: x.asDict(recursive=True) for x in df.collect()} for df in (was, now))
    a[0]["contributors"] = []
    a[0]["twice"] = False
    for i, row in a.items():
        assert row == b[i], i
    assert sum(len(x["authors"]) > 1 for x in b.values()) > 100 and sum(x["list_author"]["hole"] for x in b.values()) > 20


def test_any_invisible_follows_invisible_chars(spark):
    texts = [None, "", "a b", "é͸", *[f"a{chr(c)}b" for c in [*range(1, 0x200), 0x200A, 0x200B, 0x200D, 0xAD, 0xE000, 0xF8FF,
             0xFFF9, 0xFFFD, 0xF0000, 0x10FFFD, 0x1F600]], "\x7fUNIQ--ref-1-QINU\x7f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(any_invisible("t").alias("now"), F.coalesce(F.size(invisible_chars("t")) > 0, F.lit(False)).alias("was"))
    assert found.where("now <> was").count() == 0 and 60 < found.where("now").count() < 120


def test_parameters_are_looked_up_once(spark):
    """Fields, identifiers and people searched the whole map for every name of their tables."""
    rows = spark.range(1).select(F.lit("{{cite book|a=1}}").alias("citation"))
    for df in (O.normalize_citations(rows), Q.with_errors(O.parse_templates(rows, "citation"))):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("ArrowEvalPython") == 2


def test_a_date_meets_the_forms_of_its_kind_only(spark):
    """Every date met all seventeen patterns."""
    texts = ["3–5 May 2001", "May 3–5, 2001", "Winter 2001–02", "n.d.", "c. 1900", "2001–02", "2001-02-03", "May 2001a", "é", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(D.is_date("t", 2026).alias("a"), D.parse_date("t", 2026)["valid"].alias("b"), D.acceptable_date("t", 2026).alias("c"))
    assert [tuple(x) for x in got.collect()] == [(x, x, y) for x, y in zip(
        [True, True, True, False, False, False, True, True, False, False],
        [True, True, True, True, True, False, True, True, False, False], strict=True)]
    text = rows.select(D.is_date("t", 2026))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" in text.lower() and "finish" not in text
