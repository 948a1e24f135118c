"""Who is who: person keys, merging, and joining weak identities to strong ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import text as t

OWNER_KEY = "self"
SCOPE = ["ws", "import_id"]


def person_key(url: Column, email: Column, name: Column, company: Column) -> Column:
    """Strongest identity available: profile handle, address, name with company, name; else null."""
    folded, employer = t.comparison_key(name), t.company_key(company)
    by_name = F.when(employer != "", F.concat(F.lit("nc:"), folded, F.lit("|"), employer)).otherwise(F.concat(F.lit("name:"), folded))
    return F.coalesce(
        F.concat(F.lit("url:"), t.profile_slug(url)), F.concat(F.lit("email:"), t.nullif_blank(email)), F.when(folded != "", by_name)
    )


def owner_key(url: Column) -> Column:
    return F.coalesce(F.concat(F.lit("url:"), t.profile_slug(url)), F.lit(OWNER_KEY))


def is_strong(key: Column) -> Column:
    return F.startswith(key, F.lit("url:")) | F.startswith(key, F.lit("email:"))


def first_known(column: str, order: Column) -> Column:
    """Value of the first row, in arrival order, that has one."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)


PERSON_FIELDS = ["name", "first_name", "last_name", "headline", "location", "industry", "profile_url", "email",
                 "current_company", "current_title", "connected_at"]


def merge_people(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row per key: first known value of each field, owner if any row says so, best confidence."""
    return rows.groupBy(*(scope or SCOPE), "person_key").agg(
        *[first_known(c, F.col("ord")) for c in PERSON_FIELDS],
        F.max("is_self").alias("is_self"), F.max("confidence").alias("confidence"),
        F.min_by("source_file", "ord").alias("source_file"), F.min("ord").alias("ord"),
    )


def merge_companies(rows: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return rows.filter(F.col("company_key") != "").groupBy(*(scope or SCOPE), "company_key").agg(
        first_known("name", F.col("ord")), first_known("linkedin_url", F.col("ord")), first_known("industry", F.col("ord"))
    )


def weak_to_strong(people: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, person_key, strong_key): weak keys whose name belongs to exactly one strong identity.
    Ambiguous names are left alone; the owner is never merged by name."""
    keys = scope or SCOPE
    named = people.filter(~F.col("is_self")).withColumn("_name", t.comparison_key(F.col("name"))).filter("_name <> ''")
    strong = (
        named.filter(is_strong(F.col("person_key"))).groupBy(*keys, "_name")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("person_key").alias("strong_key")).filter("_n = 1").drop("_n")
    )
    weak = named.filter(~is_strong(F.col("person_key"))).select(*keys, "_name", "person_key")
    return weak.join(strong, [*keys, "_name"]).select(*keys, "person_key", "strong_key")


FILLED_FROM_WEAK = ["headline", "location", "industry", "email", "current_company", "current_title", "connected_at"]


def reconcile_people(people: DataFrame, remap: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Fold weak rows into their strong row, whose own values come first."""
    keys = scope or SCOPE
    rows = people.join(remap, [*keys, "person_key"], "left").withColumn("_weak", F.col("strong_key").isNotNull())
    order = F.struct("_weak", "ord")
    own = [c for c in PERSON_FIELDS if c not in FILLED_FROM_WEAK]
    return (
        rows.withColumn("person_key", F.coalesce("strong_key", "person_key")).groupBy(*keys, "person_key")
        .agg(*[F.min_by(c, order).alias(c) for c in [*own, "is_self", "confidence", "source_file", "ord"]],
             *[first_known(c, order) for c in FILLED_FROM_WEAK])
    )


def remap_keys(child: DataFrame, remap: DataFrame, scope: list[str] | None = None) -> DataFrame:
    keys = scope or SCOPE
    return (
        child.join(remap, [*keys, "person_key"], "left")
        .withColumn("person_key", F.coalesce("strong_key", "person_key")).drop("strong_key")
    )


def weak_to_stored(people: DataFrame, stored: DataFrame) -> DataFrame:
    """(ws, import_id, person_key, strong_key) against people of earlier imports, by case-folded name."""
    known = (
        stored.filter(is_strong(F.col("person_key"))).groupBy("ws", F.lower("name").alias("_name"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("person_key").alias("strong_key")).filter("_n = 1").drop("_n")
    )
    weak = people.filter(~is_strong(F.col("person_key")) & (F.col("person_key") != OWNER_KEY)).select(
        "ws", "import_id", "person_key", F.lower("name").alias("_name")
    )
    return weak.join(known, ["ws", "_name"]).select("ws", "import_id", "person_key", "strong_key")


def resolve_counterparts(conversations: DataFrame, people: DataFrame) -> DataFrame:
    """Conversations with `person_id`: by profile handle, else by a name only one person has."""
    by_url = people.select("ws", F.col("person_key").alias("_key"), F.col("person_id").alias("_by_url"))
    by_name = (
        people.groupBy("ws", F.lower("name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("person_id").alias("_by_name"))
        .filter("_n = 1").drop("_n")
    )
    return (
        conversations.withColumn("_key", F.concat(F.lit("url:"), t.profile_slug(F.col("counterpart_url"))))
        .withColumn("_name", F.lower("counterpart_name"))
        .join(by_url, ["ws", "_key"], "left").join(by_name, ["ws", "_name"], "left")
        .withColumn("person_id", F.coalesce("_by_url", "_by_name")).drop("_key", "_name", "_by_url", "_by_name")
    )
