"""Field presence over connection records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.functions import metrics as m

FIELDS = {
    "profileUrl": "profile_url", "company": "current_company", "title": "current_title",
    "location": "location", "connectionDate": "connected_at", "email": "email", "observedIndustry": "industry",
}


def field_coverage(people: DataFrame) -> DataFrame:
    """(ws, field, known, unknown, total, percent) for seven fields, from one pass."""
    present = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    counted = people.groupBy("ws").agg(
        F.count(F.lit(1)).alias("total"), *[present(c).alias(f) for f, c in FIELDS.items()]
    )
    return (
        counted.unpivot(["ws", "total"], list(FIELDS), "field", "known")
        .select("ws", "field", m.coverage(F.col("known"), F.col("total")).alias("c")).select("ws", "field", "c.*")
    )


def quality_summary(people: DataFrame, employment: DataFrame, education: DataFrame) -> DataFrame:
    urls = (
        people.filter(F.col("profile_url") != "").groupBy("ws", F.lower("profile_url").alias("u"))
        .agg(F.count(F.lit(1)).alias("n")).groupBy("ws").agg(F.sum("n").alias("urls"), F.count(F.lit(1)).alias("unique_urls"))
    )
    many = (
        employment.groupBy("ws", "person_id").count().filter("count > 1")
        .groupBy("ws").agg(F.count(F.lit(1)).alias("people_with_employment_history"))
    )
    schooled = (
        education.filter(F.col("school") != "").select("ws", "person_id").distinct()
        .join(people.select("ws", "person_id"), ["ws", "person_id"], "left_semi")
        .groupBy("ws").agg(F.count(F.lit(1)).alias("people_with_education"))
    )
    joined = people.groupBy("ws").agg(F.count(F.lit(1)).alias("total"))
    for part in (urls, many, schooled):
        joined = joined.join(part, "ws", "left")
    joined = joined.fillna(0)
    repeats = m.ratio(F.col("urls") - F.col("unique_urls"), F.col("urls"))
    return joined.select(
        "ws", "total", F.round(repeats, 9).alias("duplicate_url_rate"), "people_with_employment_history", "people_with_education"
    )


def field_counts(people: DataFrame) -> DataFrame:
    """The dashboard's variant: presence counts side by side."""
    return people.groupBy("ws").agg(
        F.count(F.lit(1)).alias("total"), F.count("current_company").alias("with_company"),
        F.count("current_title").alias("with_title"), F.count("location").alias("with_location"),
        F.count("email").alias("with_email"), F.count("connected_at").alias("with_connection_date"),
    )
