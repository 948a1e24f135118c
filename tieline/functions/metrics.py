"""Rounding, shares and coverage: the trust wrappers every metric carries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round1(c: Column) -> Column:
    """Half-up to one decimal."""
    return F.floor(c * 10 + 0.5) / 10


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return round1(ratio(numerator, denominator) * 100)


def share(numerator: Column, denominator: Column) -> Column:
    return F.struct(
        numerator.cast("long").alias("numerator"),
        denominator.cast("long").alias("denominator"),
        F.round(ratio(numerator, denominator), 9).alias("ratio"),
        percent(numerator, denominator).alias("percent"),
    )


def coverage(known: Column, total: Column) -> Column:
    return F.struct(
        known.cast("long").alias("known"),
        F.greatest(total - known, F.lit(0)).cast("long").alias("unknown"),
        total.cast("long").alias("total"),
        percent(known, total).alias("percent"),
    )
