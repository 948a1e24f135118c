"""Keyset pages: the rows after a given one, and the rows that pages of a size start after.

Pages by number rank all rows before them; these seek instead, so page 1,000 costs as much as page 1. An order is a list of
`(column, descending, nulls_first)` that ends with the id, which makes it total."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.session import checkpoint_dir

Order = list[tuple[str, bool, bool]]
UP, DOWN = (False, False), (True, False)  # nulls last

PEOPLE: dict[str, Order] = {
    "name": [("name", False, True)],
    "connected_desc": [("connected_at", *DOWN), ("name", False, True)],
    "connected_asc": [("connected_at", *UP), ("name", False, True)],
    "company": [("current_company", *UP), ("name", False, True)],
    "interaction": [("last_interaction_at", *DOWN), ("interaction_count", *DOWN), ("name", False, True)],
    "relevance": [("rank", *DOWN), ("name", False, True)],
}
COMPANIES: dict[str, Order] = {"connections": [("connection_count", *DOWN), ("name", False, True)], "name": [("name", False, True)]}
CONVERSATIONS: Order = [("last_message_at", *DOWN)]
JOBS: Order = [("used_at", *DOWN), ("title", False, True)]  # used_at: applied_at, else saved_at


def people_order(sort: str) -> Order:
    if sort not in PEOPLE:
        raise ValueError(f"unknown sort {sort!r}")
    return [*PEOPLE[sort], ("person_id", False, True)]


def columns_of(order: Order) -> list[Column]:
    def one(name: str, descending: bool, nulls_first: bool) -> Column:
        c = F.col(name)
        if descending:
            return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()

    return [one(*key) for key in order]


def _beyond(order: Order, start: str) -> Column:
    """The row lies after the one whose keys are the fields of the struct `start`."""
    out, tied = F.lit(False), F.lit(True)
    for name, descending, nulls_first in order:
        here, there = F.col(name), F.col(f"{start}.{name}")
        further = (here < there) if descending else (here > there)
        if nulls_first:
            further = F.when(there.isNull(), here.isNotNull()).otherwise(F.coalesce(further, F.lit(False)))
        else:
            further = F.when(there.isNull(), F.lit(False)).otherwise(here.isNull() | further)
        out, tied = out | (tied & further), tied & here.eqNullSafe(there)
    return out


def first(df: DataFrame, order: Order, limit: int) -> DataFrame:
    """The first page of every workspace. A task sends `limit` rows of a workspace at most."""
    rank = F.row_number().over(W.partitionBy("ws").orderBy(*columns_of(order)))
    return df.withColumn("position", rank).filter(F.col("position") <= limit)


def after(df: DataFrame, order: Order, cursors: DataFrame, limit: int) -> DataFrame:
    """The page after each workspace's cursor: `ws` and the columns of the order, one row per workspace. Workspaces without one have no page.
    The row a cursor was taken from need not exist any more."""
    keys = [name for name, *_ in order]
    start = cursors.select("ws", F.struct(*keys).alias("_start"))
    return first(df.join(start, "ws").filter(_beyond(order, "_start")).drop("_start"), order, limit)


def starts(df: DataFrame, order: Order, limit: int) -> DataFrame:
    """(ws, page, the columns of the order): for each page but the first, the row it comes after.

    Only the columns of the order are sorted, in ranges that no workspace keeps in one task: a row's position is the number of rows of
    earlier ranges plus its place in its own. The ranges are stored, so that both passes see the same ones."""
    keys = [name for name, *_ in order]
    spark = df.sparkSession
    ranged = df.select("ws", *keys).repartitionByRange(F.col("ws"), *columns_of(order)).withColumn("_range", F.spark_partition_id())
    path = f"{checkpoint_dir(spark)}/tieline-pages-{uuid.uuid4().hex}"
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sizes = ranged.groupBy("ws", "_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy("ws").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("ws", "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("ws", "_range").orderBy(*columns_of(order)))
    position = F.col("_before") + F.col("_place")
    rows = ranged.withColumn("_place", place).join(before, ["ws", "_range"])
    return rows.filter(position % limit == 0).select("ws", (position / limit + 1).cast("long").alias("page"), *keys)
