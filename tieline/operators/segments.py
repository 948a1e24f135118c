"""Saved segments as a table of rules, evaluated together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import text as t
from tieline.functions.dates import age_days
from tieline.operators.growth import instant
from tieline.operators.scoring import PERSON, with_context
from tieline.sources.facts import NetworkFacts

RULE = "company string, pastCompany string, role string, industry string, location string, recentlyMoved boolean, olderQuiet boolean"
RULE_KEYS = [field.split()[0] for field in RULE.split(", ")]
NAME_LENGTH = 80


def refused(batch: DataFrame) -> DataFrame:
    """Rows of a batch (ws, name, query) that cannot be saved, with the reason."""
    parsed = F.from_json("query", RULE)
    unknown = F.array_except(F.coalesce(F.json_object_keys("query"), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in RULE_KEYS]))
    length = F.length(F.trim(F.coalesce("name", F.lit(""))))
    reason = (
        F.when(F.col("ws").isNull(), "no workspace").when((length == 0) | (length > NAME_LENGTH), f"a name has 1 to {NAME_LENGTH} characters")
        .when(F.json_object_keys("query").isNull() | parsed.isNull(), "the query is no JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown filter "), F.array_join(unknown, ", ")))
    )
    return batch.withColumn("reason", reason).filter("reason IS NOT NULL")


def rules(segments: DataFrame) -> DataFrame:
    """One row per segment with folded filters, empty where not given. Segments without any filter hold nobody and are left out."""
    parsed = segments.select("ws", "segment_key", F.from_json("query", RULE).alias("_q"))
    folded = lambda name: t.key_of(F.col(f"_q.{name}"))
    lower = lambda name: F.lower(F.coalesce(F.col(f"_q.{name}"), F.lit("")))
    flag = lambda name: F.coalesce(F.col(f"_q.{name}"), F.lit(False))
    out = parsed.select(
        "ws", "segment_key", folded("company").alias("_company"), folded("pastCompany").alias("_past"), lower("role").alias("_role"),
        folded("industry").alias("_industry"), lower("location").alias("_location"), flag("recentlyMoved").alias("_moved"), flag("olderQuiet").alias("_quiet"))
    return out.filter("concat(_company, _past, _role, _industry, _location) <> '' OR _moved OR _quiet")


def _unless(given: str, holds: Column) -> Column:
    return (F.col(given) == "") | holds


def members(segments: DataFrame, facts: NetworkFacts, now: str) -> DataFrame:
    """(ws, segment_key, person_id, context_score): everyone in every segment of their workspace.

    People are classified and scored once, whatever the number of segments. The table of rules is small and joins by workspace with its
    conditions inside the join; Spark broadcasts it only where its measured size allows. Former employers are matched once for each
    distinct employer of a workspace, not for each person."""
    wanted = rules(segments)
    past = facts.employment.filter(~F.col("is_current")).select(*PERSON, t.effective_key(F.col("company_key"), F.col("company_name")).alias("_key"))
    sought = wanted.filter("_past <> ''").select("ws", "_past").distinct()
    employers = past.select("ws", "_key").distinct().join(sought, "ws").filter(F.contains("_key", "_past"))
    worked = past.join(employers, ["ws", "_key"]).select(*PERSON, "_past").distinct().withColumn("_worked", F.lit(True))

    age = lambda c: age_days(instant(now), F.col(c))
    key = t.effective_key(F.col("current_company_key"), F.col("current_company"))
    people = with_context(facts, now).select(
        *PERSON, "score", key.alias("_at"), t.key_of(F.col("current_company")).alias("_at_name"), F.lower("current_title").alias("_title"),
        F.col("_class.key").alias("_class_key"), t.key_of(F.col("_class.label")).alias("_class_name"), F.lower("location").alias("_place"), "employers",
        ((age("connected_at") / 365.25 >= 2) & (F.col("last_interaction_at").isNull() | (age("last_interaction_at") > 365))).alias("_is_quiet"))
    found = people.join(wanted, "ws").filter(
        _unless("_company", F.contains("_at", "_company") | (F.col("_at_name") == F.col("_company")))
        & _unless("_role", F.contains("_title", "_role"))
        & _unless("_industry", (F.col("_class_key") == F.col("_industry")) | (F.col("_class_name") == F.col("_industry")))
        & _unless("_location", F.contains("_place", "_location"))
        & (~F.col("_moved") | (F.col("employers") >= 2)) & (~F.col("_quiet") | F.col("_is_quiet"))
    )
    return found.join(worked, [*PERSON, "_past"], "left").filter(_unless("_past", F.col("_worked"))).select(
        "ws", "segment_key", "person_id", F.col("score").alias("context_score"))
