"""Concentration and diversity of a distribution's bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import fixed_values as fv, metrics as m
from tieline.functions.templates import number


def diversity_band(normalized: Column) -> Column:
    return (
        F.when(normalized >= fv.DIVERSITY_HIGH, "high").when(normalized >= fv.DIVERSITY_MODERATE, "moderate")
        .otherwise("low")
    )


def concentration(bins: DataFrame, top_n: int = 5) -> DataFrame:
    """One row per workspace and dimension. With N the sum of counts,
    HHI = Σn²/N² and entropy = ln N − Σ(n·ln n)/N, so plain sums are enough and no bin is shuffled twice."""
    n = F.col("count").cast("double")
    sums = bins.groupBy("ws", "dimension").agg(
        F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(n * F.ln(n)).alias("nlogn"),
        F.count(F.lit(1)).alias("groups"), F.max("known").alias("known"), F.max("total").alias("total"),
    )
    largest = F.row_number().over(W.partitionBy("ws", "dimension").orderBy(F.col("count").desc(), "key"))
    top = (
        bins.select("ws", "dimension", "count", "key").withColumn("_rank", largest).filter(F.col("_rank") <= top_n)
        .groupBy("ws", "dimension").agg(F.sum("count").alias("top"))
    )
    out = sums.join(top, ["ws", "dimension"])
    total = F.col("n")
    hhi = F.when(total > 0, F.col("nn") / (total * total)).otherwise(F.lit(0.0))
    entropy = F.when(total > 0, F.greatest(F.ln(total) - F.col("nlogn") / total, F.lit(0.0))).otherwise(F.lit(0.0))
    out = out.withColumn("hhi", F.round(hhi, 9)).withColumn("entropy", F.round(entropy, 9))
    normalized = F.when(F.col("groups") > 1, F.round(F.col("entropy") / F.ln("groups"), 9)).otherwise(F.lit(0.0))
    out = out.withColumn("normalized_entropy", normalized).withColumn(
        "top_share", m.percent(F.col("top"), F.col("known"))
    )
    shown = F.least(F.lit(top_n), F.col("groups")).cast("string")
    explanation = (
        F.when(F.col("known") == 0, F.lit("Not enough classified records to measure concentration."))
        .when(F.col("hhi") >= fv.CONCENTRATION_HIGH, F.concat(
            F.lit("The network is concentrated: the top "), shown, F.lit(" groups account for "), number(F.col("top_share")),
            F.lit("% of classified records (HHI "), number(m.round1(F.col("hhi") * 10000)), F.lit(" on the 0–10,000 scale).")))
        .when(F.col("hhi") >= fv.CONCENTRATION_MODERATE, F.concat(
            F.lit("Moderate concentration. The top "), shown, F.lit(" groups account for "), number(F.col("top_share")),
            F.lit("% of classified records.")))
        .otherwise(F.concat(
            F.lit("The classified records are spread across many groups. The top "), shown, F.lit(" account for "),
            number(F.col("top_share")), F.lit("%.")))
    )
    return out.select(
        "ws", "dimension", "hhi", "entropy", "normalized_entropy",
        diversity_band(F.col("normalized_entropy")).alias("diversity_band"),
        F.col("top").cast("long").alias("top_count"), "top_share", F.col("groups").cast("long").alias("groups"),
        F.col("known").cast("long").alias("known"), F.col("total").cast("long").alias("total"),
        m.percent(F.col("known"), F.col("total")).alias("coverage_percent"), explanation.alias("explanation"),
    )


def diversity(companies: DataFrame, industries: DataFrame, countries: DataFrame, locations: DataFrame,
              roles: DataFrame) -> DataFrame:
    """Bands for four dimensions; geography uses countries where any are known, else raw locations."""
    named = lambda bins, name: concentration(bins).select(
        "ws", F.lit(name).alias("dimension"), "diversity_band", "hhi", "known"
    )
    without_country = locations.join(countries.select("ws").distinct(), "ws", "left_anti")
    return (
        named(companies, "companies").unionByName(named(industries, "industries"))
        .unionByName(named(countries.unionByName(without_country), "geography"))
        .unionByName(named(roles, "roles"))
    )
