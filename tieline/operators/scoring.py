"""Relationship context score and rule-based opportunity search."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import classify, fixed_values as fv, text as t
from tieline.functions.dates import age_days, iso_day
from tieline.operators.growth import instant
from tieline.sources.facts import NetworkFacts

PERSON = ["ws", "person_id"]
DISCLAIMER = (
    "This is a Relationship Context Score from observable overlap in the export. "
    "It is not relationship strength, trust, or how well you know this person."
)


def _owner_profile(owners: DataFrame) -> DataFrame:
    """(ws, _self_industry, _self_country, _has_owner). The owner's industry comes from the observed
    field, else from the alphabetically first of their employers."""
    first = owners.withColumn("_employer", F.array_min("company_keys"))
    classed = classify.with_industry(first, F.col("industry"), F.lit(None).cast("string"), F.col("_employer"), "_class")
    placed = classify.with_geo(classed, F.col("location"), "_geo")
    return placed.select(
        "ws", F.col("_class.key").alias("_self_industry"), F.col("_geo.country").alias("_self_country"),
        F.lit(True).alias("_has_owner"),
    )


def _careers(facts: NetworkFacts) -> DataFrame:
    """(ws, person_id, employers, shared_employers): distinct keys, and those the owner has too."""
    mine = facts.owners.select("ws", F.explode("company_keys").alias("_key")).withColumn("_mine", F.lit(1))
    keys = facts.employment.select(
        *PERSON, t.effective_key(F.col("company_key"), F.col("company_name")).alias("_key")
    ).filter("_key <> ''").distinct()
    return keys.join(mine, ["ws", "_key"], "left").groupBy(*PERSON).agg(
        F.count(F.lit(1)).alias("employers"), F.count("_mine").alias("shared_employers")
    )


def _classmates(facts: NetworkFacts) -> DataFrame:
    mine = facts.owners.select("ws", F.explode("schools").alias("_school"))
    at = facts.education.filter(F.col("school") != "").select(*PERSON, F.lower(F.trim("school")).alias("_school"))
    return at.join(mine, ["ws", "_school"], "left_semi").select(*PERSON).distinct().withColumn("_classmate", F.lit(True))


def with_context(facts: NetworkFacts, now: str) -> DataFrame:
    """People with `score` and `contributions`, an array of struct(key, label, points, evidence)."""
    people = classify.with_geo(
        classify.with_industry(facts.people, F.col("industry"), F.col("current_title"), F.col("current_company"), "_class"),
        F.col("location"), "_geo",
    )
    rows = (
        people.join(_careers(facts), PERSON, "left").join(_classmates(facts), PERSON, "left")
        .join(_owner_profile(facts.owners), "ws", "left")
        .withColumn("employers", F.coalesce("employers", F.lit(0))).withColumn("shared_employers", F.coalesce("shared_employers", F.lit(0)))
    )
    years = age_days(instant(now), F.col("connected_at")) / 365.25
    fields = [(F.col(c) != "").cast("int") for c in ("profile_url", "current_company", "current_title")]
    complete = sum((F.coalesce(f, F.lit(0)) for f in fields), F.col("connected_at").isNotNull().cast("int"))
    text = lambda c: c.cast("string")
    signals: dict[str, tuple[Column, Column]] = {
        "shared_company": (F.col("shared_employers") > 0, F.concat(
            F.lit("Worked at a company also on your profile ("), text(F.col("shared_employers")), F.lit(" overlap)."))),
        "shared_school": (F.col("_classmate"), F.lit("Attended a school also on your profile.")),
        "common_industry": (F.col("_class.key") == F.col("_self_industry"), F.concat(
            F.lit("Both classified as "), F.col("_class.label"), F.lit(" ("), F.col("_class.trust"), F.lit(")."))),
        "common_country": (F.col("_geo.country") == F.col("_self_country"), F.concat(
            F.lit("Both located in "), F.col("_geo.country"), F.lit("."))),
        "connected_1_5y": ((years >= 1) & (years < 5), F.concat(F.lit("Connected On is "), iso_day(F.col("connected_at")), F.lit("."))),
        "career_change": (F.col("employers") > 1, F.concat(text(F.col("employers")), F.lit(" distinct employers in employment history."))),
        "profile_completeness": (complete >= 3, F.concat(
            text(complete), F.lit(" of 4 core fields present (URL, company, title, connection date)."))),
    }
    parts = [
        F.when(holds, F.struct(F.lit(key).alias("key"), F.lit(fv.CONTEXT_SIGNALS[key][0]).alias("label"),
                               F.lit(fv.CONTEXT_SIGNALS[key][1]).alias("points"), evidence.alias("evidence")))
        for key, (holds, evidence) in signals.items()
    ]
    scored = rows.withColumn("contributions", F.array_compact(F.array(*parts)))
    points = F.aggregate("contributions", F.lit(0), lambda total, c: total + c["points"])
    return scored.withColumn("score", F.least(points, F.lit(100))).drop("_geo", "_classmate", "_self_industry", "_self_country", "_has_owner")


@dataclass
class OpportunityQuery:
    company: str | None = None
    past_company: str | None = None
    role: str | None = None
    industry: str | None = None
    location: str | None = None
    recently_moved: bool = False
    older_quiet: bool = False

    @classmethod
    def from_json(cls, text: str) -> "OpportunityQuery":
        """The query a saved segment stores; unknown keys are refused."""
        given = json.loads(text)
        names = {"pastCompany": "past_company", "recentlyMoved": "recently_moved", "olderQuiet": "older_quiet"}
        return cls(**{names.get(k, k): v for k, v in given.items()})


def find_opportunities(facts: NetworkFacts, now: str, wanted: OpportunityQuery, limit: int = 50) -> DataFrame:
    """People matching every given filter, with one reason each, by score then name. No filter, no rows."""
    rows, reasons = with_context(facts, now), []
    folded = lambda v: (v or "").strip().lower()
    if folded(wanted.company):
        key = t.effective_key(F.col("current_company_key"), F.col("current_company"))
        rows = rows.filter(F.contains(key, F.lit(folded(wanted.company))) | (t.key_of(F.col("current_company")) == folded(wanted.company)))
        reasons.append(F.concat(F.lit("Works at "), F.coalesce("current_company", F.lit("null"))))
    if folded(wanted.past_company):
        past = facts.employment.filter(
            ~F.col("is_current")
            & F.contains(t.effective_key(F.col("company_key"), F.col("company_name")), F.lit(folded(wanted.past_company)))
        ).select(*PERSON)
        rows = rows.join(past, PERSON, "left_semi")
        reasons.append(F.lit("Previously worked at a matching company"))
    if wanted.role:
        rows = rows.filter(F.contains(F.lower("current_title"), F.lit(wanted.role.lower())))
        reasons.append(F.lit(f"Title contains “{wanted.role}”"))
    if folded(wanted.industry):
        rows = rows.filter((F.col("_class.key") == folded(wanted.industry)) | (t.key_of(F.col("_class.label")) == folded(wanted.industry)))
        reasons.append(F.concat(F.lit("Classified industry: "), F.col("_class.label"), F.lit(" ("), F.col("_class.confidence"), F.lit(" confidence)")))
    if wanted.location:
        rows = rows.filter(F.contains(F.lower("location"), F.lit(wanted.location.lower())))
        reasons.append(F.lit(f"Location contains “{wanted.location}”"))
    if wanted.recently_moved:
        rows = rows.filter("employers >= 2")
        reasons.append(F.lit("More than one employer on record"))
    if wanted.older_quiet:
        age = lambda c: age_days(instant(now), F.col(c))
        quiet = F.col("last_interaction_at").isNull() | (age("last_interaction_at") > 365)
        rows = rows.filter((age("connected_at") / 365.25 >= 2) & quiet)
        reasons.append(F.lit("Connected over 2 years ago with no recorded contact in the last year"))
    if not reasons:
        rows = rows.limit(0)
        reasons = [F.lit("")]
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.col("score").desc(), F.col("name").asc(), F.col("person_id").asc()))
    return (
        rows.withColumn("position", rank).filter(F.col("position") <= limit)
        .select("ws", "position", "person_id", "name", "current_company", "current_title",
                F.array(*reasons).alias("reasons"), F.col("score").alias("context_score"))
    )


def reconnection_candidates(facts: NetworkFacts, now: str, limit: int = 25) -> DataFrame:
    return find_opportunities(facts, now, OpportunityQuery(older_quiet=True), limit)
