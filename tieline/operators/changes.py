"""What changed between the two latest imports that held connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tieline.functions import fixed_values as fv, text as t


def import_pair(imports: DataFrame) -> DataFrame:
    """(ws, current_import, previous_import, limitation): the latest qualifying import and the one before."""
    qualifying = imports.filter(F.col("had_connections") & F.col("status").isin(fv.COMPLETED_STATUSES))
    newest = F.row_number().over(
        W.partitionBy("ws").orderBy(F.col("uploaded_at").desc(), F.col("import_id").desc())
    )
    return (
        qualifying.withColumn("_rank", newest).filter("_rank <= 2").groupBy("ws")
        .agg(F.max(F.when(F.col("_rank") == 1, F.col("import_id"))).alias("current_import"),
             F.max(F.when(F.col("_rank") == 2, F.col("import_id"))).alias("previous_import"))
        .withColumn("limitation", F.when(
            F.col("previous_import").isNull(),
            "Only one connections import is on file. New vs previous requires a later export.",
        ).otherwise(
            "People not present in the latest Connections.csv are listed as not seen in that import. That is not proof they were removed from LinkedIn."
        ))
    )


def new_connections(people: DataFrame, imports: DataFrame) -> DataFrame:
    current = import_pair(imports).select("ws", F.col("current_import").alias("first_import_id"))
    return people.join(current, ["ws", "first_import_id"]).select("ws", "person_id", "name")


def not_seen(people: DataFrame, imports: DataFrame) -> DataFrame:
    """People of earlier imports that the latest one does not hold; silent without an earlier import."""
    compared = import_pair(imports).filter(F.col("previous_import").isNotNull()).select("ws", "current_import")
    return (
        people.filter(F.col("last_import_id").isNotNull()).join(compared, "ws")
        .filter(F.col("last_import_id") != F.col("current_import")).select("ws", "person_id", "name")
    )


def company_changes(moves: DataFrame) -> DataFrame:
    return moves.select(
        "ws", "person_id", "name", F.lit("company").alias("field"),
        F.col("from_company").alias("from"), F.col("to_company").alias("to"),
    )


def title_changes(moves: DataFrame) -> DataFrame:
    """Distinct title pairs of moves whose titles differ; a title alone is never a change."""
    named = moves.filter((F.col("from_title") != "") & (F.col("to_title") != ""))
    differ = t.key_of(F.col("from_title")) != t.key_of(F.col("to_title"))
    return named.filter(differ).select(
        "ws", "person_id", "name", F.lit("title").alias("field"),
        F.col("from_title").alias("from"), F.col("to_title").alias("to"),
    ).distinct()
