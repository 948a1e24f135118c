"""What the operators of this subpackage share: inputs by exact column name, stored tables, word rules, prefix sums."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tieline.session import checkpoint_dir

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
BLANKS = " \t\n\x0b\f\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name; any other columns are left out, whatever they are called, also where they differ from a
    wanted one in case only. Of several columns of the same exact name the first counts."""
    at = {n: df.columns.index(n) for n in names}
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(n) for n, i in at.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later steps start from files that every executor can read, and the shuffle files
    of the step are dropped when it ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 500, size: str = "16m") -> None:
    """Arrow batches that hold long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def blanks_to_spaces(text: Column) -> Column:
    return F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1))


def words(text: Column) -> Column:
    """`[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(blanks_to_spaces(text), F.lit("")), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def running_start(counts: DataFrame, groups: list[str], bucket: str, amount: str, alias: str, width: int = 1024) -> DataFrame:
    """`counts` with the sum of `amount` over the smaller buckets of the same groups. Two levels, so that no window holds more than
    `width` buckets of a block or the block totals of a group."""
    block = F.floor(F.col(bucket) / width)
    inner = Window.partitionBy(*groups, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*groups, F.floor(F.col("_block") / width)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_block", block)
    blocks = counts.groupBy(*groups, "_block").agg(F.sum(amount).alias("_total"))
    supers = blocks.groupBy(*groups, F.floor(F.col("_block") / width).alias("_super")).agg(F.sum("_total").alias("_super_total"))
    top = Window.partitionBy(*groups).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1) if groups else Window.partitionBy(F.lit(0)).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.withColumn("_super_start", F.coalesce(F.sum("_super_total").over(top), F.lit(0))).drop("_super_total")
    blocks = blocks.withColumn("_super", F.floor(F.col("_block") / width)).withColumn("_block_start", F.coalesce(F.sum("_total").over(outer), F.lit(0))).drop("_total")
    starts = same(blocks, supers, [*groups, "_super"]).select(*groups, "_block", (F.col("_block_start") + F.col("_super_start")).alias("_start"))
    out = counts.withColumn("_own", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return same(out, starts, [*groups, "_block"]).withColumn(alias, F.col("_own") + F.col("_start")).drop("_own", "_start", "_block")


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; null equals null. The keys of the left side stay."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for k in keys:
        one = left[k].eqNullSafe(right[f"_r_{k}"])
        condition = one if condition is None else condition & one
    return left.join(right, condition, how).drop(*[f"_r_{k}" for k in keys])


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`df` with `rank`, a row's number in its group by `order` (from 0, nulls first, ties as they come), and `total`, the group's rows.

    Rows are dealt by ranges of group, order and arrival, so that neither one group nor many equal rows share a task by rule; row
    numbers inside a range and the ranges' counts give ranks, without a window over rows."""
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie")
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)).drop("_tie"), "ranks")
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    counts = stored(running_start(counts, group, "_range", "_n", "_before"), "ranges")
    if group:
        starts = same(counts, counts.groupBy(*group).agg(F.sum("_n").alias("total")), group)
    else:
        starts = counts.withColumn("total", F.lit(counts.agg(F.sum("_n")).first()[0]).cast("long"))
    starts = starts.select(*group, "_range", (F.col("_before") - F.col("_first")).alias("_shift"), "total")
    return same(dealt, starts, [*group, "_range"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")
