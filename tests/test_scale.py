"""What keeps the step that many queries share cheap: one walk for the spans."""

import os
import re
import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from refloom.functions import braces as B
from refloom.functions import dates as DT
from refloom.functions import identifiers as I
from refloom.functions import urls as U
from refloom.operators import quality as Q
from refloom.operators.citations import extract_citations, parse_templates
from refloom.plans import derived as D
from refloom.plans.q_wikitext import templates_per_page


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_found_by_one_walk(spark, sf):
    """The fold over brace runs in built-in functions is gone, and no filter runs the walk a second time."""
    pages = D.articles(spark, sf)
    assert plan(extract_citations(pages)).count("ArrowEvalPython") == 1
    assert plan(templates_per_page(spark, sf)).count("ArrowEvalPython") == 1
    assert plan(parse_templates(D.citations(spark, sf), "citation")).count("ArrowEvalPython") == 1


def test_span_finder_needs_no_package_on_workers():
    """A worker that cannot import this package loads the function and runs it."""
    program = (
        "import pickle, sys, pyarrow as pa\n"
        "f = pickle.loads(sys.stdin.buffer.read())\n"
        "assert not any(m.startswith('refloom') for m in sys.modules)\n"
        "print(f(pa.array(['{{a}}'])).to_pylist()[0][0]['text'])"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    told = subprocess.run(
        [sys.executable, "-c", program], input=cloudpickle.dumps(B._found_spans.func), capture_output=True, cwd="/", env=env,
        check=True,
    )
    assert told.stdout == b"{{a}}\n"


def test_spans_of_null_and_empty_texts(spark):
    rows = [(None,), ("",), ("{{a}}",), ("<NoWiki>{{n}}</nowiki >{{é|{{𝒳}}}}",), ("{" * 7 + "x" + "}" * 7,)]
    got = spark.createDataFrame(rows, "t string").select(B.brace_spans("t").alias("s")).collect()
    assert [r.s if r.s is None else [(s.start, s.end, s.kind, s.text) for s in r.s] for r in got] == [
        None,
        [],
        [(0, 5, "template", "{{a}}")],
        [(23, 34, "template", "{{é|{{𝒳}}}}"), (27, 32, "template", "{{𝒳}}")],
        [(1, 14, "argument", "{" * 6 + "x" + "}" * 6), (4, 11, "argument", "{{{x}}}")],
    ]


def test_parts_of_every_date_form(spark):
    """The runs of digits and letters are what the groups of the form's own pattern hold, and no pattern depends on the row."""
    made = {"([1-9]\\d{3})": "1999", "([1-9]\\d{2,3})": "1850", "([1-9]\\d?)": "7", "([A-Za-z]+)": "May", "[A-Za-z]?": "b", " +": "  ",
            "(\\d\\d)": "03", "(\\d{4})": "2004", "(\\d{2})": "12"}
    texts = []
    for form in DT.FORMS:
        text = form.pattern.strip("^$")
        for pattern, value in made.items():
            text = text.replace(pattern, value)
        assert re.match(form.pattern, text), (form.name, text)
        texts.append((form.name, text))
    rows = spark.createDataFrame(texts, "f string, t string").select("f", "t", DT._parts(F.col("t"), F.col("f")).alias("p"))
    for r in rows.collect():
        form = next(f for f in DT.FORMS if f.name == r.f)
        found = re.match(form.pattern, r.t).groups()
        want = [found[g - 1] if g else None for g in form.first + form.second]
        assert [r.p.year, r.p.month, r.p.day and str(r.p.day)] == want[:3]
        assert r.p.month2 == want[4] and (r.p.day2 and str(r.p.day2)) == want[5]
        assert r.p.year2 == (r.p.year[:2] + want[3] if r.f in ("sy-yy", "y-yy") else want[3])
    dates = spark.createDataFrame([("2001",)], "t string").select(DT.parse_date("t", 2026).alias("d"))
    assert "regexp_extract(" not in plan(dates)


def test_checks_read_a_value_once(spark):
    """What several tests of a check read is computed once, and a text that cannot hold an address is not searched for one."""
    rows = spark.createDataFrame([("978-0-306-40615-7", {"title": "a", "work": "b", "newspaper": "c"}), ("see https://example.org/c", {"title": "a"})], "t string, m map<string,string>")
    assert plan(rows.select(I.valid_isbn("t").alias("v"))).count("[-\\s]") == 1
    assert plan(rows.select(I.valid_issn("t").alias("v"))).count("regexp_replace") == 1
    links = rows.select(U.has_external_link("t").alias("l"), Q._one_field_twice(F.col("m")).alias("twice"))
    assert [tuple(r) for r in links.collect()] == [(False, True), (True, False)]
    assert plan(rows.select(U.has_external_link("t").alias("v"))).count("/[A-Za-z\\d].*, $1") == 1
