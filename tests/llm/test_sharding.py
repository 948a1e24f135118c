from collections import Counter

from llm_cases import empty, frame, rows
from tieline.llm import sharding
from tieline.llm.common import DOCUMENT, pick


def placed(df, **settings):
    return sharding.shuffled(pick(df, *DOCUMENT), 24, **settings).collect()


def test_rows_are_spread_evenly_and_slots_have_no_gaps(spark):
    for settings in ({}, {"bucket_bytes": 2000}):
        got = placed(frame(spark), **settings)
        assert Counter(tuple(r["row"]) for r in got) == Counter(rows())
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_order_is_shuffled_by_seed(spark):
    order = lambda seed: [r["row"].doc_id for r in sorted(placed(frame(spark), seed=seed, bucket_bytes=4000), key=lambda r: (r.slot, r.shard))]
    a, b, c = order(1), order(1), order(2)
    assert a == b != c and a != sorted(a, key=lambda x: (x is None, x))


def test_empty_and_equal_rows(spark):
    assert placed(empty(spark)) == []
    got = placed(frame(spark, [(1, None, None, None, None)] * 50))
    assert sorted(Counter(r.shard for r in got).values()) == [2] * 22 + [3] * 2


def test_written_shards(spark, folder):
    sharding.write_shards(pick(frame(spark), *DOCUMENT), folder + "/out", 4)
    back = spark.read.parquet(folder + "/out")
    assert back.count() == len(rows()) and back.select("shard").distinct().count() == 4


def test_frequent_rows_are_spread_over_buckets(spark):
    """A third of all rows are one row, another third have neither id nor text."""
    from pyspark.sql import functions as F

    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("same")).alias("text"))
    apart = sharding.told_apart(df, 11)
    assert apart.count() == 100_000 and apart.select("spread").distinct().count() == 100_000
    buckets = apart.groupBy(F.pmod("spread", F.lit(50))).count().agg(F.max("count")).first()[0]
    assert buckets < 2500
    got = sharding.shuffled(df, 24, bucket_bytes=20_000).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(got) == 24 and all(r.n in (4166, 4167) and r.last == r.n - 1 for r in got)


def test_law_against_plain_python(spark):
    """The query's own columns: every row once, sizes and checksums of its text, counts at most one apart, slots without gaps."""
    import zlib

    from tieline.llm import queries
    from tieline.llm.common import table

    directory = "/root/testdata/sf0.001"
    got = queries.QUERIES["op7_sharding"](spark, directory).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in table(spark, directory, "documents").collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len(t) + 8, zlib.crc32(t)) for d, t in texts)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    n = len(texts)
    assert sorted((r.shard, r.slot) for r in got) == sorted((k % 24, k // 24) for k in range(n))


def test_long_texts_beyond_a_bucket(spark):
    data = [(i, "x" * (300_000 if i % 10 == 0 else 10), "en", "s", 1) for i in range(60)]
    got = placed(frame(spark, data), bucket_bytes=100_000)
    assert Counter(tuple(r["row"]) for r in got) == Counter(data) and sorted(r.slot * 24 + r.shard for r in got) == list(range(60))
