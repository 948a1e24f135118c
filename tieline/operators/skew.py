"""Helpers that keep a single very large group from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_previous(df: DataFrame, keys: list[str], order: list[str], segment: Column, value: Column, out: str) -> DataFrame:
    """`lag(value)` within `keys` in ascending `order` (nulls first), for groups of any size.

    `segment` must be non-decreasing in `order`. Windows hold the rows of one segment of a group, which also puts the segment's last value on its
    first row. Only first rows go on to a window over their group, where each takes the value of the segment before it."""
    forward = [F.col(c).asc_nulls_first() for c in order]
    inside = W.partitionBy(*keys, "_segment").orderBy(*forward)
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = df.withColumn("_segment", segment).select(
        "*", F.lag(value).over(inside).alias(out), (F.row_number().over(inside) == 1).alias("_first"), F.last(value).over(whole).alias("_last"))
    between = W.partitionBy(*keys).orderBy(F.col("_segment").asc_nulls_first())
    firsts = rows.filter("_first").withColumn(out, F.lag("_last").over(between))
    return firsts.select(*df.columns, out).unionByName(rows.filter("NOT _first").select(*df.columns, out))
