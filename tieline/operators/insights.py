"""Evidence-backed insights: one rule per id, each a projection of small metric tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import fixed_values as fv, metrics as m
from tieline.functions.templates import fill, number, people_have
from tieline.operators.distributions import network_size, underrepresented
from tieline.operators.growth import instant


@dataclass
class InsightInput:
    """The metric tables insights are read from."""

    people: DataFrame
    companies: DataFrame
    industries: DataFrame
    company_concentration: DataFrame
    growth: DataFrame
    moves: DataFrame
    movers: DataFrame
    fields: DataFrame
    new: DataFrame
    gone: DataFrame
    imports: DataFrame


def coverage_note(known: Column, unknown: Column, percent: Column, noun: str) -> Column:
    return fill("{k} " + noun + " classified, {u} unknown ({p}% coverage).", k=known, u=unknown, p=number(percent))


def _largest(bins: DataFrame, min_known: int) -> DataFrame:
    first = F.row_number().over(W.partitionBy("ws").orderBy(F.col("count").desc(), F.col("label").asc()))
    return bins.filter(F.col("known") >= min_known).withColumn("_rank", first).filter("_rank = 1")


def _insight(df: DataFrame, rule: str, order: int, *, numerator: Column, denominator: Column, affected: Column, metric: str,
             values: dict[str, Column], id_: Column | None = None, value: Column | None = None, percent: Column | None = None,
             confidence: Column | None = None, title: Column | None = None, known: Column | None = None,
             total: Column | None = None, period: tuple[Column, Column, str] | None = None, assumptions: Column | None = None) -> DataFrame:
    text, none = fv.INSIGHTS[rule], F.lit(None).cast("string")
    notes = text.get("assumptions")
    fixed = F.array(*[F.lit(a) for a in notes]) if notes else F.array().cast("array<string>")
    nothing = F.lit(None).cast("long")
    start, end, label = period or (F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), None)
    return df.select(
        "ws", F.lit(order).alias("rule_order"), (F.lit(rule) if id_ is None else id_).alias("id"),
        (fill(text["title"], **values) if title is None else title).alias("title"),
        fill(text["description"], **values).alias("description"), F.lit(text["category"]).alias("category"),
        (F.lit("high") if confidence is None else confidence).alias("confidence"), F.lit(text["trust"]).alias("trust"),
        F.lit(text["why"]).alias("why_interesting"), fill(text["evidence"], **values).alias("evidence"),
        fill(text["expression"], **values).alias("expression"), numerator.cast("long").alias("numerator"),
        denominator.cast("long").alias("denominator"),
        (m.percent(numerator, denominator) if percent is None else percent).alias("percent"),
        (nothing if known is None else known.cast("long")).alias("coverage_known"),
        (nothing if total is None else total.cast("long")).alias("coverage_total"),
        start.alias("period_from"), end.alias("period_to"), F.lit(label).cast("string").alias("period_label"),
        (fixed if assumptions is None else assumptions).alias("assumptions"), affected.cast("long").alias("affected_count"),
        F.lit(metric).alias("drill_metric"), (none if value is None else value).alias("drill_value"),
    )


def generate_insights(given: InsightInput, now: str) -> DataFrame:
    c = F.col
    unknown = (c("total") - c("known")).alias("unknown")
    of_bin = {k: c(k) for k in ("count", "label", "known", "total", "method")} | {
        "unknown": unknown, "share_of_known": number(c("share_of_known")), "share_of_network": number(c("share_of_network"))}
    parts = []

    parts.append(_insight(
        _largest(given.companies, 10), "top-company", 1, numerator=c("count"), denominator=c("total"), affected=c("count"),
        metric="company", value=c("key"), percent=c("share_of_network"), known=c("known"), total=c("total"), values=of_bin))

    spread = given.company_concentration.filter("known >= 20")
    titles = fv.INSIGHTS["company-concentration"]["title"]
    title = F.when(c("diversity_band") == "low", titles["low"]).when(c("diversity_band") == "high", titles["high"]).otherwise(titles["moderate"])
    parts.append(_insight(
        spread, "company-concentration", 2, numerator=c("top_count"), denominator=c("known"), percent=c("top_share"), title=title,
        affected=c("known"), metric="company", known=c("known"), total=c("total"),
        values={"explanation": c("explanation"), "hhi": F.format_string("%.3f", c("hhi")), "coverage_percent": number(c("coverage_percent"))}))

    parts.append(_insight(
        _largest(given.industries, 15), "top-industry", 3, numerator=c("count"), denominator=c("known"), percent=c("share_of_known"),
        affected=c("count"), metric="industry", value=c("key"), confidence=c("confidence"), known=c("known"), total=c("total"),
        assumptions=c("assumptions"), values=of_bin))

    small = underrepresented(given.industries)
    rank = F.row_number().over(W.partitionBy("ws").orderBy(c("count").desc(), c("label").asc()))
    gaps = small.withColumn("_rank", rank).filter("_rank <= 3")
    parts.append(_insight(
        gaps, "gap-industry", 4, numerator=c("count"), denominator=c("known"), percent=c("share_of_known"), affected=c("count"),
        id_=F.concat(F.lit("gap-industry-"), c("key")), metric="industry", value=c("key"), confidence=c("confidence"),
        known=c("known"), total=c("total"), assumptions=c("assumptions"), values=of_bin))

    dated = given.growth.filter("known >= 10")
    period = (instant(now) - F.expr("INTERVAL '90' DAY"), instant(now), "Last 90 days")
    parts.append(_insight(
        dated, "growth-window", 5, numerator=c("last_90_days"), denominator=c("known"), affected=c("last_90_days"), metric="recent",
        known=c("known"), total=c("total"), period=period,
        values={"last_90_days": c("last_90_days"), "known": c("known"), "total": c("total"), "acceleration": c("acceleration"),
                "coverage_percent": number(c("coverage_percent")), "earliest_day": F.date_format("earliest", "yyyy-MM-dd")}))

    size = network_size(given.people)
    moved = (
        given.movers.groupBy("ws").agg(F.count(F.lit(1)).alias("people"))
        .join(given.moves.groupBy("ws").agg(F.count(F.lit(1)).alias("moves")), "ws", "left").fillna(0).join(size, "ws")
    )
    parts.append(_insight(
        moved, "career-moves", 6, numerator=c("people"), denominator=c("total"), affected=c("people"), metric="changed_company",
        values={"people": c("people"), "people_have": people_have(c("people")), "moves": c("moves")}))

    placed = given.fields.filter("field = 'location' AND percent < 5")
    parts.append(_insight(
        placed, "location-coverage", 7, numerator=c("known"), denominator=c("total"), percent=c("percent"), affected=c("unknown"),
        metric="quality", value=F.lit("location"), known=c("known"), total=c("total"),
        values={"known": c("known"), "total": c("total"), "percent": number(c("percent")), "unknown": c("unknown")}))

    counted = lambda df, name: df.groupBy("ws").agg(F.count(F.lit(1)).alias(name))
    compared = (
        given.imports.filter(F.col("previous_import").isNotNull()).join(counted(given.new, "new"), "ws")
        .join(counted(given.gone, "gone"), "ws", "left").fillna(0, ["gone"]).join(size, "ws")
    )
    parts.append(_insight(
        compared, "new-since-import", 8, numerator=c("new"), denominator=c("total"), affected=c("new"), metric="new_since_import",
        values={"new": c("new"), "gone": c("gone"), "current_import": c("current_import")}))
    return reduce(lambda a, b: a.unionByName(b), parts)
