"""Relationship signals: rules over imported facts, usable as filter, flag or count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import fixed_values as fv
from tieline.operators.growth import instant
from tieline.sources.facts import owner_companies, owner_schools

SIGNAL_KEYS = [key for key, *_ in fv.SIGNALS]


def check_signal(key: str) -> str:
    if key not in SIGNAL_KEYS:
        raise ValueError(f"unknown signal {key!r}")
    return key


def with_signals(people: DataFrame, employment: DataFrame, education: DataFrame, everyone: DataFrame, now: str) -> DataFrame:
    """Adds one boolean column per signal. `everyone` holds the owners, whose employers and schools
    decide overlap; employment and education are reduced to one row per person before the join."""
    mine = owner_companies(everyone, employment).withColumn("_mine", F.lit(1))
    careers = (
        employment.filter(F.col("company_key").isNotNull()).select("ws", "person_id", "company_key").distinct()
        .join(mine, ["ws", "company_key"], "left").groupBy("ws", "person_id")
        .agg((F.count(F.lit(1)) > 1).alias("changed_company"), (F.max("_mine") == 1).alias("shared_company"))
    )
    schools = (
        education.select("ws", "person_id", F.lower("school").alias("school_key"))
        .join(owner_schools(everyone, education), ["ws", "school_key"], "left_semi")
        .select("ws", "person_id").distinct().withColumn("shared_school", F.lit(True))
    )
    joined = people.join(careers, ["ws", "person_id"], "left").join(schools, ["ws", "person_id"], "left")
    at, contact, today = F.col("connected_at"), F.col("last_interaction_at"), instant(now)
    back = lambda span: today - F.expr(f"INTERVAL {span}")
    rules = {
        "recent": at >= back("'90' DAY"),
        "long_standing": at <= back("'5' YEAR"),
        "dormant": (at <= back("'2' YEAR")) & (contact.isNull() | (contact <= back("'1' YEAR"))),
        "engaged": F.col("interaction_count") > 0,
        "changed_company": F.col("changed_company"),
        "shared_company": F.col("shared_company"),
        "shared_school": F.col("shared_school"),
        "no_company": F.col("current_company").isNull(),
    }
    return joined.withColumns({k: F.coalesce(rule, F.lit(False)) for k, rule in rules.items()})


def signal_array() -> Column:
    """Keys of the signals that hold, in catalogue order."""
    return F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in SIGNAL_KEYS]))


def signal_counts(flagged: DataFrame) -> DataFrame:
    """(ws, key, label, kind, rule, count), zero counts included."""
    counts = flagged.groupBy("ws").agg(*[F.count_if(F.col(k)).alias(k) for k in SIGNAL_KEYS])
    long = counts.unpivot(["ws"], SIGNAL_KEYS, "key", "count")
    about = F.create_map(*[
        x for key, label, kind, rule in fv.SIGNALS
        for x in (F.lit(key), F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule")))
    ])
    return long.withColumn("_about", about[F.col("key")]).select("ws", "key", "_about.label", "_about.kind", "_about.rule", "count")


def reconnect_suggestions(flagged: DataFrame, limit: int = 20) -> DataFrame:
    """People with a reason to reconnect, movers first, then shared employers and schools, oldest first."""
    from pyspark.sql import Window as W

    chosen = flagged.filter(F.col("dormant") | F.col("changed_company") | F.col("shared_company") | F.col("shared_school"))
    reasons = F.array_compact(F.array(*[F.when(F.col(k), F.lit(text)) for k, text in fv.SUGGESTION_REASONS]))
    order = W.partitionBy("ws").orderBy(
        F.col("changed_company").desc(), F.col("shared_company").desc(), F.col("shared_school").desc(),
        F.col("connected_at").asc_nulls_last(), F.col("person_id"),
    )
    return (
        chosen.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
        .select("ws", "position", "person_id", "name", "current_company", "current_title", "profile_url",
                reasons.alias("reasons"), "connected_at", "last_interaction_at")
    )
