"""Derived tables, each a full recomputation from base rows, so running twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def link_employment(employment: DataFrame, companies: DataFrame) -> DataFrame:
    """Attach employment rows without a company to the company with their key."""
    ids = companies.select("ws", "company_key", F.col("company_id").alias("_linked"))
    return (
        employment.join(ids, ["ws", "company_key"], "left")
        .withColumn("company_id", F.coalesce("company_id", "_linked")).drop("_linked")
    )


def retire_snapshots(employment: DataFrame) -> DataFrame:
    """Of a person's rows without dates only those observed last stay current.

    The latest time is a partial aggregate joined back, not a window, so a person with very many
    rows never lands in a single task before aggregation."""
    undated = F.col("start_date").isNull() & F.col("end_date").isNull()
    latest = employment.filter(undated).groupBy("ws", "person_id").agg(F.max("observed_at").alias("_latest"))
    older = undated & (F.col("observed_at") < F.col("_latest"))
    return (
        employment.join(latest, ["ws", "person_id"], "left")
        .withColumn("is_current", F.col("is_current") & ~F.coalesce(older, F.lit(False))).drop("_latest")
    )


def owner_current_role(employment: DataFrame, people: DataFrame) -> DataFrame:
    """The owner's latest current row: (ws, person_id, current_company, current_title)."""
    owners = people.filter("is_self").select("ws", "person_id")
    order = [F.col("started_on").desc_nulls_last(), F.col("observed_at").desc(), F.col("employment_id").desc()]
    rank = F.row_number().over(W.partitionBy("ws", "person_id").orderBy(*order))
    return (
        employment.filter("is_current").join(owners, ["ws", "person_id"], "left_semi")
        .withColumn("_rank", rank).filter("_rank = 1")
        .select("ws", "person_id", F.col("company_name").alias("current_company"), F.col("title").alias("current_title"))
    )


def interaction_totals(conversations: DataFrame, messages: DataFrame, interactions: DataFrame) -> DataFrame:
    """Messages and recorded touchpoints per person: (ws, person_id, interaction_count, last_interaction_at).

    Messages are counted per conversation before the join, so the join sees one row per conversation."""
    per_conversation = messages.groupBy("ws", "conversation_id").agg(
        F.count(F.lit(1)).alias("hits"), F.max("sent_at").alias("last_at")
    )
    spoken = (
        conversations.filter(F.col("person_id").isNotNull()).select("ws", "conversation_id", "person_id")
        .join(per_conversation, ["ws", "conversation_id"]).select("ws", "person_id", "hits", "last_at")
    )
    touched = interactions.groupBy("ws", "person_id").agg(
        F.count(F.lit(1)).alias("hits"), F.max("occurred_at").alias("last_at")
    )
    return spoken.unionByName(touched).groupBy("ws", "person_id").agg(
        F.sum("hits").alias("interaction_count"), F.max("last_at").alias("last_interaction_at")
    )


def conversation_totals(messages: DataFrame) -> DataFrame:
    return messages.groupBy("ws", "conversation_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("sent_at").alias("last_message_at"),
        F.min("sent_at").alias("started_at"),
    )


def company_totals(companies: DataFrame, employment: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct people per company, the owner excluded; companies without rows keep 0."""
    owners = people.filter("is_self").select("ws", "person_id")
    # One row per company and person first: the distinct counts then become plain counts.
    per_person = (
        employment.filter(F.col("company_id").isNotNull()).groupBy("ws", "company_id", "person_id")
        .agg(F.max(F.col("is_current").cast("int")).alias("now"), F.min(F.col("is_current").cast("int")).alias("always"))
        .join(owners, ["ws", "person_id"], "left_anti")
    )
    counts = per_person.groupBy("ws", "company_id").agg(
        F.count(F.lit(1)).alias("connection_count"), F.sum("now").alias("current_count"),
        F.sum(1 - F.col("always")).alias("former_count"),
    )
    return companies.join(counts, ["ws", "company_id"], "left").fillna(
        0, ["connection_count", "current_count", "former_count"]
    )


def connection_dates(people: DataFrame, connections: DataFrame) -> DataFrame:
    """Copy a connection's date onto its person where it differs."""
    dates = connections.filter(F.col("connected_at").isNotNull()).select(
        "ws", "person_id", F.col("connected_at").alias("_at")
    )
    return (
        people.join(dates, ["ws", "person_id"], "left")
        .withColumn("connected_at", F.coalesce("_at", "connected_at")).drop("_at")
    )


def derive_stats(people: DataFrame, employment: DataFrame, companies: DataFrame) -> DataFrame:
    """Per workspace: linked rows, companies, people and people with more than one employer (the owner counts)."""
    moved = (
        employment.filter(F.col("company_key").isNotNull()).select("ws", "person_id", "company_key").distinct()
        .groupBy("ws", "person_id").count().filter("count > 1")
        .groupBy("ws").agg(F.count(F.lit(1)).alias("career_moves_observed"))
    )
    linked = employment.groupBy("ws").agg(F.count("company_id").alias("employment_linked"))
    scored = companies.groupBy("ws").agg(F.count(F.lit(1)).alias("companies_scored"))
    return (
        people.groupBy("ws").agg(F.count(F.lit(1)).alias("people_scored"))
        .join(linked, "ws", "left").join(scored, "ws", "left").join(moved, "ws", "left").fillna(0)
    )


def skill_totals(endorsements: DataFrame) -> DataFrame:
    """Endorsements per person and case-folded skill; the first spelling names it."""
    return (
        endorsements.groupBy("ws", "person_id", F.lower("skill").alias("skill_key"))
        .agg(F.min_by("skill", "ord").alias("skill"), F.sum("points").alias("endorsements"))
    )
