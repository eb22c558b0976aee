"""Queries that return an operator's whole result, against plain counting over the same tables."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from refloom.operators import extraction as X
from refloom.operators import labels as L
from refloom.plans import derived as D
from refloom.plans.q_citations import with_id_list

QUERIES = entry.queries()


@pytest.fixture
def rows(spark, sf):
    return lambda name: QUERIES[name](spark, sf).collect()


def test_links_without_a_title(rows, spark, sf):
    links = X.extract_external_links(D.articles(spark, sf)).select("url", "title").collect()
    scheme = re.compile("^([a-z]+):")
    want = Counter((scheme.match(r.url) or [None, ""])[1] for r in links)
    assert {r.scheme: r.n for r in rows("link_schemes_whole")} == want
    assert sum(want.values()) > sum(r.n for r in rows("link_schemes"))


def test_records(rows, spark, sf):
    works = {r.pk: json.loads(r.works)["message"].get("items") or [] for r in D.records(spark, sf).select("pk", "works").collect()}
    found = rows("top_candidates_whole")
    assert {r.pk: len(r.titles.split("|")) if r.titles else 0 for r in found} == {pk: len(w[:3]) for pk, w in works.items()}
    assert all((r.message is None) == bool(works[r.pk]) for r in found)
    ids = {r.pk: r.ids for r in rows("crossref_ids_whole")}
    assert set(ids) == {pk for pk, w in works.items() if w}
    assert all(("ISBN:" in ids[pk]) == bool(w[0].get("ISBN")) for pk, w in works.items() if w)
    assert any("ISBN:" in x for x in ids.values())


def test_kinds_types_and_groups(rows, spark, sf):
    want = with_id_list(spark, sf).select(F.map_filter("ID_list", lambda k, v: v.isNotNull()).alias("m")).collect()
    got = rows("id_pivot_whole")
    assert len(L.KINDS) > 9
    assert Counter(k for r in got for k in L.KINDS if r[k] is not None) == Counter(k for r in want for k in r.m)
    assert {sum(v for k, v in r.asDict().items() if k != "page_id") for r in rows("type_dummies_whole")} == {1}
    assert set(rows("invisible_chars")) <= set(rows("invisible_chars_whole"))


def test_sections(rows, spark, sf):
    pairs = Counter()
    for r in rows("section_dummies_whole"):
        pairs.update(k for k, v in r.asDict().items() if v == 1 and k not in ("page_id", "citations"))
    from refloom.operators import citations as O

    found = O.extract_citations(D.articles(spark, sf)).select("page_id", "citations", "sections_all").collect()
    want = Counter(s for _, _, some in {(r.page_id, r.citations, tuple(sorted(set(r.sections_all)))) for r in found} for s in some)
    assert pairs == want and len(want) > 3


def test_citations_are_parsed_once_for_both_sides(spark, sf):
    """Queries that use labelled citations twice keep them as a stage: no plan of theirs holds the parse."""
    from refloom.plans import q_context

    for name in ("join_by_key", "labelled_dataset"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
    plan = q_context._training(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
