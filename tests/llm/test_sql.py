"""Native operators against their SQL on the awkward rows and the smallest tables."""

from collections import Counter

import duckdb
import pytest
from llm_cases import empty, frame, rows
from tieline.llm import host_rules, line_dedup, queries



def compare(df, sql, con):
    columns = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(repr([r[i] for i in order]) for r in rel.fetchall())
    assert Counter(repr([r[c] for c in columns]) for r in df.collect()) == want


def connection(data):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
    return con


def spread_lines():
    """Lines on every number of sources around the threshold, with and without white space around them."""
    data = rows()
    for n in range(line_dedup.MIN_SITES - 4, line_dedup.MIN_SITES + 6):
        data += [(1000 * n + i, "own %d %d\n %s\t\nend" % (n, i, "line on %d sites" % n), "en", "site%d" % (i % n), 1) for i in range(3 * n)]
    return data + [(None, "line on 12 sites", "en", "x", 1)]


def test_line_dedup(spark):
    data = spread_lines()
    compare(line_dedup.dedup_lines(frame(spark, data)), line_dedup.SQL, connection(data))
    assert line_dedup.dedup_lines(empty(spark)).collect() == []


def test_lines_far_beyond_the_threshold_are_decided_by_their_sketch(spark):
    data = [(i, "everywhere\nhere %d" % i, "en", "site%d" % i, 1) for i in range(400)]
    compare(line_dedup.dedup_lines(frame(spark, data)), line_dedup.SQL, connection(data))


def bad_host():
    good = " ".join("w%d" % i for i in range(30))
    return rows() + [(2000 + i, "no words" if i % 4 else good, "en", "bad", 1) for i in range(200)] + [(3000 + i, good + " x%d" % i, "en", "good", 1) for i in range(200)]


def test_host_rules(spark):
    for data in (rows(), bad_host()):
        compare(host_rules.host_verdicts(frame(spark, data)), host_rules.SQL, connection(data))
    got = {r.doc_id: r for r in host_rules.host_verdicts(frame(spark, bad_host())).collect()}
    assert not got[2000].base_failed and not got[2000].kept  # goes with its host
    assert got[3000].kept
    assert host_rules.host_verdicts(empty(spark)).collect() == []


@pytest.mark.parametrize("text, repeated", [("a b c d", 0), ("a b c d e", 0), ("a b c d e a b c d e", 10), ("a a a a a a", 6), ("a b c d e f a b c d e x a b c d e", 15), ("", 0)])
def test_repeated_words(spark, text, repeated):
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert host_rules.measured(df).first().n_repeat_words == repeated


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.SQL[name], con)
