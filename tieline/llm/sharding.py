"""Two-pass shuffle into shards: an even scatter into buckets of bounded size, then a Fisher-Yates shuffle of each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import running_start, stored

COPIES = 1 << 16  # of one row that a task writes out


def text_size(text: Column) -> Column:
    """UTF-8 bytes, and 8 for the frame of a record; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def told_apart(docs: DataFrame, seed: int) -> DataFrame:
    """(row, spread): the rows of `docs` as structs, and a hash that differs between rows, also between rows that repeat another whole."""
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns]).alias("spread"))
    again = stored(rows.groupBy("spread").count().filter("count > 1").select("spread"), "repeated")
    if again.isEmpty():
        return rows
    copies = rows.join(again, "spread", "left_semi").groupBy("row", "spread").count()
    # A row that is very frequent is written out again by many tasks.
    parts = copies.select("row", "spread", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(COPIES).cast("long"))).alias("first"))
    parts = parts.repartition("spread", "first")
    each = parts.select("row", "spread", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("count")) - 1)).alias("copy"))
    return rows.join(again, "spread", "left_anti").unionByName(each.select("row", F.xxhash64("spread", "copy").alias("spread")))


def shuffled(docs: DataFrame, shards: int, seed: int = 11, bucket_bytes: int = 16 << 20, task_bytes: int = 1 << 30) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) as (row, shard, slot), where row holds all their columns.

    First pass: a seeded hash of all columns, and of its number where a whole row repeats, scatters rows over as many buckets as hold about
    `bucket_bytes` each; a task gets buckets of about `task_bytes`. Second pass: each bucket, put in a fixed order first, is shuffled by
    the array function `shuffle`, which is Fisher-Yates; its seed goes with the task, whose buckets follow from their numbers. The
    buckets end to end are one random order; row k of it goes to slot k div `shards` of shard k mod `shards`, so the counts are at most
    one apart, whatever sources, ids, texts or sizes are frequent. Null ids and texts are values like any other; a single longer text
    than a bucket fills one. A table without rows gives none."""
    total = docs.agg(F.sum(text_size(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    tasks = max(min(buckets, docs.sparkSession.sparkContext.defaultParallelism), -(-total // task_bytes))
    rows = told_apart(docs, seed).withColumn("bucket", F.pmod("spread", F.lit(buckets)))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = running_start(counts, [], "bucket", "n", "start").select("bucket", "start")
    scattered = rows.select("bucket", F.struct("spread", "row").alias("record")).repartition(tasks, "bucket")
    filled = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list("record")).alias("records")).sortWithinPartitions("bucket")
    mixed = filled.select("bucket", F.shuffle("records", F.lit(seed)).alias("records")).join(starts, "bucket")
    placed = mixed.select("start", F.posexplode("records").alias("pos", "record"))
    rank = F.col("start") + F.col("pos")
    return placed.select("record.row", (rank % shards).cast("int").alias("shard"), F.floor(rank / shards).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, **settings: int) -> None:
    """One folder a shard, rows in slot order, with the columns of `docs` (which have no shard or slot of their own) and slot. What
    `shuffled` says of nulls, ties, repeated rows and long texts holds; a table without rows writes no shard."""
    placed = shuffled(docs, shards, **settings).select("row.*", "shard", "slot")
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
