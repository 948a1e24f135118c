import re
from collections import Counter, defaultdict

import pytest
from llm_cases import SCHEMA, empty, frame, rows
from tieline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Excess shared again by weight until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        free = [s for s in order if s not in full]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in full else share[s] for s in order}
        full |= above


@pytest.mark.parametrize("settings", [{}, {"block": 64, "bucket_words": 500}])
def test_every_source_reaches_its_target(spark, settings):
    data = rows()
    numbered = mixing.numbered(frame(spark))
    found = mixing.taken(numbered, **settings).collect()
    size = lambda r: len(WORD.findall(r[1] or ""))
    sizes, got = defaultdict(int), defaultdict(int)
    for r in data:
        sizes[r[3]] += size(r)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], size(r)) for r in data)
    want = targets(sizes)
    source = {r.row: r.source for r in numbered.collect()}
    for r in found:
        s = source[r.row]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    assert all(abs(got[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    again = mixing.taken(mixing.numbered(frame(spark)), **settings).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_schedule_spreads_each_source_evenly(spark):
    t = spark.createDataFrame([("a", 1, 600_000.0), ("b", 1, 300_000.0), (None, 1, 100_000.0)], "source string, source_size long, target double")
    plan = sorted(mixing.schedule(t, 1000).collect(), key=lambda r: (r.slot, r.source or ""))
    assert sum(r.words for r in plan) == 1_000_000
    for s, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
        ranks = [r["rank"] for r in plan if r.source == s]
        assert ranks == list(range(len(ranks)))
        for upto in range(100, 1000, 50):
            assert abs(sum(r.source == s for r in plan if r.slot < upto) - share * upto) < 6


def test_points_are_the_golden_ratio_sequence(spark):
    slots = [0, 1, 2, 12345, 2**31 + 7, 2**40 + 3]
    got = spark.createDataFrame([(s,) for s in slots], "s long").select(mixing.points(mixing.F.col("s")).alias("u")).collect()
    assert [r.u for r in got] == [s * 2654435769 % 2**32 for s in slots]


def test_awkward_tables(spark):
    assert mixing.taken(mixing.numbered(empty(spark))).collect() == []
    none = [(i, None, None, None, None) for i in range(3)] + [(9, "", "en", "x", 0)]
    assert {(r.size, r.target, r.taken) for r in mixing.taken(mixing.numbered(frame(spark, none))).collect()} == {(0, 0.0, 0)}


def test_repeated_rows_follow_the_mix(spark):
    data = [r for r in rows() if r[0] is not None and r[0] < 60][:60]
    data = [r for r in dict((r[0], r) for r in data).values()]
    docs = spark.createDataFrame(data, SCHEMA)
    taken = {r.doc_id: r for r in mixing.taken(mixing.numbered(docs)).collect()}
    copies = Counter(r.doc_id for r in mixing.repeated(docs).collect())
    for d, r in taken.items():
        assert copies[d] == (int(r.taken / r.size + 0.5) if r.size else 0)


def test_many_rows_without_words(spark):
    """They would all share one bucket of their source, as buckets are counted by words."""
    bare = spark.range(200_000).selectExpr("id + 1000 AS doc_id", "CASE WHEN id % 2 = 0 THEN ' ' END AS text", "'en' AS lang", "'src1' AS source", "0L AS n_chars")
    data = [r for r in rows() if r[0] is not None]
    found = mixing.taken(mixing.numbered(spark.createDataFrame(data, SCHEMA).union(bare)))
    got = found.groupBy(mixing.F.col("doc_id") >= 1000).agg(mixing.F.count("*"), mixing.F.sum("taken")).collect()
    assert sorted(got)[1][1:] == (200_000, 0) and sorted(got)[0][1] == len(data) and sorted(got)[0][2] > 0
    placed = mixing.streams(mixing.numbered(spark.createDataFrame(data, SCHEMA).union(bare)), 5, 1 << 20)
    sizes = placed.filter("size = 0").agg(mixing.F.max("begin")).first()[0]
    assert sizes == 0
