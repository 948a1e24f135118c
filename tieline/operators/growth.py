"""Growth over connection dates. `now` is always given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import fixed_values as fv, metrics as m
from tieline.functions.dates import age_days


def instant(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def monthly(people: DataFrame) -> DataFrame:
    """Months with additions: (ws, month_start, added)."""
    return (
        people.filter(F.col("connected_at").isNotNull())
        .groupBy("ws", F.trunc("connected_at", "month").alias("month_start"))
        .agg(F.count(F.lit(1)).alias("added"))
    )


def growth_series(people: DataFrame) -> DataFrame:
    """Every month from the first to the last with a running total. The windows run over month
    rows, of which a workspace has as many as its calendar, not its people."""
    months = monthly(people)
    axis = (
        months.groupBy("ws").agg(F.min("month_start").alias("a"), F.max("month_start").alias("z"), F.sum("added").alias("dated"))
        .select("ws", "dated", F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("month_start"))
    )
    so_far = W.partitionBy("ws").orderBy("month_start").rowsBetween(W.unboundedPreceding, 0)
    return (
        axis.join(months, ["ws", "month_start"], "left").fillna(0, ["added"])
        .select("ws", F.date_format("month_start", "yyyy-MM").alias("month"), "added",
                F.sum("added").over(so_far).alias("cumulative"), "dated",
                m.percent(F.col("added"), F.col("dated")).alias("share_of_dated"))
    )


def growth_observed_months(people: DataFrame) -> DataFrame:
    """The dashboard's variant: months without additions are left out."""
    so_far = W.partitionBy("ws").orderBy("month_start").rowsBetween(W.unboundedPreceding, 0)
    return monthly(people).select(
        "ws", F.date_format("month_start", "yyyy-MM").alias("month"), "added",
        F.sum("added").over(so_far).alias("cumulative"),
    )


def growth_summary(people: DataFrame, now: str) -> DataFrame:
    age = age_days(instant(now), F.col("connected_at"))
    sums = people.groupBy("ws").agg(
        F.count("connected_at").alias("known"), F.count(F.lit(1)).alias("total"),
        F.min("connected_at").alias("earliest"), F.max("connected_at").alias("latest"),
        F.count_if(age <= 90).alias("last_90_days"), F.count_if((age > 90) & (age <= 180)).alias("previous_90_days"),
    )
    last, before = F.col("last_90_days"), F.col("previous_90_days")
    acceleration = (
        F.when(last + before < 8, "unknown").when(last > before * 1.25, "accelerating")
        .when(last < before * 0.75, "decelerating").otherwise("steady")
    )
    return sums.select(
        "ws", "known", "total", m.percent(F.col("known"), F.col("total")).alias("coverage_percent"),
        "earliest", "latest", "last_90_days", "previous_90_days", acceleration.alias("acceleration"),
    )


def unusual_months(people: DataFrame) -> DataFrame:
    """Months at least two sample standard deviations above the mean, in series of a year or more."""
    series = growth_series(people)
    spread = series.groupBy("ws").agg(
        F.count(F.lit(1)).alias("months"), F.avg("added").alias("mean"), F.coalesce(F.stddev_samp("added"), F.lit(0.0)).alias("sd")
    )
    z = F.when(F.col("sd") > 0, (F.col("added") - F.col("mean")) / F.col("sd"))
    return (
        series.join(spread, "ws").withColumn("z_score", F.round(z, 9))
        .filter((F.col("months") >= 12) & (F.col("z_score") >= 2)).select("ws", "month", "added", "z_score")
    )


def recency(people: DataFrame, now: str, buckets: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Counts per age bucket; buckets without people are kept."""
    chosen = sorted(buckets or fv.RECENCY_BUCKETS, key=lambda b: b[2])
    days = age_days(instant(now), F.col("connected_at"))
    place = F.lit(len(chosen) - 1)
    for i in reversed(range(len(chosen) - 1)):
        place = F.when(days < chosen[i][2], F.lit(i)).otherwise(place)
    counted = (
        people.filter(F.col("connected_at").isNotNull()).groupBy("ws", place.alias("position"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    sizes = people.groupBy("ws").agg(F.count(F.lit(1)).alias("total"), F.count("connected_at").alias("known"))
    names = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(label).alias("label")) for k, label, _ in chosen])
    every = sizes.select("ws", "total", "known", F.posexplode(names).alias("position", "bucket"))
    return (
        every.join(counted, ["ws", "position"], "left").fillna(0, ["count"])
        .select("ws", F.col("bucket.key").alias("key"), F.col("bucket.label").alias("label"), "count", "known", "total",
                m.percent(F.col("count"), F.col("known")).alias("share_of_known"),
                m.percent(F.col("count"), F.col("total")).alias("share_of_network"))
    )
