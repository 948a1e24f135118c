"""Career moves: consecutive employment rows of one person with different company keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.functions import classify, text as t
from tieline.operators.skew import with_previous


def _keyed(employment: DataFrame) -> DataFrame:
    return employment.withColumn(
        "_key", t.effective_key(F.col("company_key"), F.col("company_name"))
    ).filter("_key <> ''")


def career_moves(people: DataFrame, employment: DataFrame) -> DataFrame:
    """Moves in the order started_on, observed_at, current last, employment_id.

    Only each row's predecessor is looked at, so very long histories split by day segments."""
    observed = F.coalesce("observed_at", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    order = ["started_on", "_observed", "is_current", "employment_id"]
    rows = _keyed(employment).withColumn("_observed", observed).select(
        "ws", "person_id", "employment_id", "company_name", "_key", "title", "is_current", "started_on",
        "observed_at", "_observed",
    )
    before = F.struct("_key", "company_name", "title")
    segment = F.struct("started_on", F.date_trunc("day", "_observed").alias("day"))
    paired = with_previous(rows, ["ws", "person_id"], order, segment, before, "_before")
    moved = paired.filter(F.col("_before").isNotNull() & (F.col("_before._key") != F.col("_key")))
    named = moved.join(people.select("ws", "person_id", "name"), ["ws", "person_id"])
    return named.select(
        "ws", "person_id", "name",
        F.coalesce("_before.company_name", "_before._key").alias("from_company"), F.col("_before._key").alias("from_key"),
        F.coalesce("company_name", "_key").alias("to_company"), F.col("_key").alias("to_key"),
        F.col("_before.title").alias("from_title"), F.col("title").alias("to_title"),
        F.coalesce("observed_at", F.col("started_on").cast("timestamp_ntz")).alias("observed_at"),
        F.concat(F.col("name"), F.lit(" has employment rows at "), F.coalesce("_before.company_name", "_before._key"),
                 F.lit(" then "), F.coalesce("company_name", "_key"), F.lit(".")).alias("evidence"),
        "employment_id",
    )


def multiple_employers(people: DataFrame, employment: DataFrame) -> DataFrame:
    """(ws, person_id, employers) for people with at least two distinct company keys."""
    return (
        _keyed(employment).select("ws", "person_id", "_key").distinct().groupBy("ws", "person_id")
        .agg(F.count(F.lit(1)).alias("employers")).filter("employers > 1")
        .join(people.select("ws", "person_id"), ["ws", "person_id"], "left_semi")
    )


def career_flows(moves: DataFrame) -> DataFrame:
    """Moves per pair of companies; who moved stays available as rows of `career_moves`."""
    first = F.struct("person_id", "employment_id")
    return moves.groupBy("ws", "from_key", "to_key").agg(
        F.min_by("from_company", first).alias("from_label"), F.min_by("to_company", first).alias("to_label"),
        F.count(F.lit(1)).alias("count"), F.count_distinct("person_id").alias("people"),
    )


def role_transitions(moves: DataFrame) -> DataFrame:
    pairs = moves.groupBy("ws", "from_title", "to_title").agg(F.count(F.lit(1)).alias("n"))
    both = classify.with_role_family(pairs, F.col("from_title"), "a")
    return _shifts(classify.with_role_family(both, F.col("to_title"), "b"))


def industry_transitions(people: DataFrame, moves: DataFrame) -> DataFrame:
    """The person's observed industry describes where they arrived, not where they came from."""
    seen = moves.join(people.select("ws", "person_id", "industry"), ["ws", "person_id"], "left")
    pairs = seen.groupBy("ws", "from_title", "from_company", "to_title", "to_company", "industry").agg(
        F.count(F.lit(1)).alias("n")
    )
    both = classify.with_industry(pairs, F.lit(None).cast("string"), F.col("from_title"), F.col("from_company"), "a")
    return _shifts(classify.with_industry(both, F.col("industry"), F.col("to_title"), F.col("to_company"), "b"))


def _shifts(classed: DataFrame) -> DataFrame:
    moved = classed.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.key") != F.col("b.key")))
    keyed = moved.groupBy("ws", F.col("a.key").alias("from_key"), F.col("b.key").alias("to_key"))
    return keyed.agg(
        F.min("a.label").alias("from_label"), F.min("b.label").alias("to_label"), F.sum("n").alias("count")
    )


def moved_latest(people: DataFrame, employment: DataFrame) -> DataFrame:
    """Latest current against latest former row, where the company names differ ignoring case."""
    newest = F.struct("observed_at", "employment_id")
    named = employment.filter(F.col("company_name").isNotNull())
    ends = named.groupBy("ws", "person_id").agg(
        F.max_by(F.struct("company_name", "observed_at"), F.when(F.col("is_current"), newest)).alias("now"),
        F.max_by("company_name", F.when(~F.col("is_current"), newest)).alias("from_company"),
    )
    return (
        ends.filter(F.lower("from_company") != F.lower("now.company_name"))
        .join(people.select("ws", "person_id", "name"), ["ws", "person_id"])
        .select("ws", "person_id", "name", "from_company", F.col("now.company_name").alias("to_company"),
                F.col("now.observed_at").alias("observed_at"))
    )
