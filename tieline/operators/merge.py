"""Keyed merges: what a batch of rows does to stored rows with the same natural key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Column rules. Where only one side has the row, its value stands.
PREFER_NEW = "prefer_new"      # the new value unless it is null
PREFER_OLD = "prefer_old"      # the stored value unless it is null
KEEP = "keep"                  # the stored row's value, even when null
REPLACE = "replace"            # the new row's value, even when null
EITHER = "either"              # logical or
LARGEST = "largest"
SUM = "sum"
RULES = [PREFER_NEW, PREFER_OLD, KEEP, REPLACE, EITHER, LARGEST, SUM]


def dedupe_first(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row per key in arrival order. An aggregate, so repeats shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def one_per_key(batch: DataFrame, keys: list[str], rules: dict[str, str], order: str = "ord") -> DataFrame:
    """A batch with repeated keys reduced column by column, as if its rows were merged one after the other: the last value that is not
    null for PREFER_NEW, the first one for PREFER_OLD, the first row's for KEEP, the last one's for REPLACE, and EITHER, LARGEST and SUM over
    all. Rows follow each other by the column `order`. Without it they follow by all their values, so that the outcome does not depend on
    how they lie, and KEEP takes the largest row's value too."""
    rest = [c for c in batch.columns if c not in keys and c != order]
    ordered = order in batch.columns
    at = F.col(order) if ordered else F.struct(F.lit(True).alias("_held"), *rest)
    last = lambda c, by: F.max_by(c, by)
    first = lambda c, by: F.min_by(c, by)
    filled = lambda c: F.when(F.col(c).isNotNull(), at)
    fold = {PREFER_NEW: lambda c: last(c, filled(c)), PREFER_OLD: lambda c: first(c, filled(c)), KEEP: lambda c: (first if ordered else last)(c, at), REPLACE: lambda c: last(c, at),
            EITHER: F.bool_or, LARGEST: F.max, SUM: F.sum}
    return batch.groupBy(*keys).agg(*[fold[rules.get(c, REPLACE)](c).alias(c) for c in rest]).select(*[c for c in batch.columns if c != order])


def merge_rows(stored: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Stored rows after the batch, with `inserted` telling new rows from known ones. A column `ord` of the batch orders its rows.
    Keys must be non-null, and unique among stored rows; a batch may repeat them. Applying the same batch again changes nothing,
    unless a SUM rule is used."""
    unknown = set(rules.values()) - set(RULES)
    if unknown:
        raise ValueError(f"unknown merge rules {sorted(unknown)}")
    batch = one_per_key(batch, keys, rules)
    s, b = stored.withColumn("_old", F.lit(True)).alias("s"), batch.withColumn("_new", F.lit(True)).alias("b")
    joined = s.join(b, [F.col(f"s.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    old, new = F.col("s._old").isNotNull(), F.col("b._new").isNotNull()

    def value(column: str, rule: str) -> Column:
        o, n = F.col(f"s.{column}"), F.col(f"b.{column}")
        return {
            PREFER_NEW: F.coalesce(n, o), PREFER_OLD: F.coalesce(o, n), KEEP: F.when(old, o).otherwise(n),
            REPLACE: F.when(new, n).otherwise(o), EITHER: F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False)),
            LARGEST: F.greatest(o, n), SUM: F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0)),
        }[rule]

    return joined.select(
        *[F.coalesce(F.col(f"s.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        *[value(c, rule).alias(c) for c, rule in rules.items()], (~old).alias("inserted"),
    )
