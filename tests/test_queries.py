"""Registered queries against their SQL in DuckDB. REFLOOM_ALL=1 runs all of them, otherwise a cross-section."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SOME = [
    "label_counts", "extracted_citations", "plain_text", "sections_nested", "template_params", "normalized", "dates_iso",
    "label_news", "neighbors_40", "unk_words", "best_candidate", "char_sequence", "request_batches", "stratified_split",
]
NAMES = sorted(QUERIES) if os.environ.get("REFLOOM_ALL") else SOME
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    answer = duck.sql(ORACLES[name])
    place = [answer.columns.index(c) for c in columns]
    assert len(answer.columns) == len(columns)
    assert rows == sorted(tuple(plain(r[i]) for i in place) for r in answer.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 3
