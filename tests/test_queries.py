"""Registered queries against their SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DIRECTORY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["dist_company", "dist_industry", "dist_school", "concentration", "growth_series", "career_moves", "signals", "facets", "colleague_count",
           "related_companies", "context_score", "graph_edges", "reconcile_weak", "merge_people", "fn_parse_date", "export_connections"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIRECTORY}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DIRECTORY)
    columns = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(repr([r[i] for i in order]) for r in rel.fetchall())
    assert Counter(repr([r[c] for c in columns]) for r in df.collect()) == want


def test_every_query_has_sql():
    from tieline import checks

    registry = checks.load()
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
