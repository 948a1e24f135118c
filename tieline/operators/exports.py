"""Exports: guarded CSV tables and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.functions.dates import iso_day
from tieline.functions.text import csv_cell, formula_guard

CONNECTION_COLUMNS = {
    "Name": "name", "First Name": "first_name", "Last Name": "last_name", "Title": "current_title", "Company": "current_company",
    "Location": "location", "Industry": "industry", "Email": "email", "Profile URL": "profile_url", "Connected On": "connected_on",
    "Interactions": "interaction_count", "Tags": "tags",
}
COMPANY_COLUMNS = {
    "Company": "name", "Industry": "industry", "Location": "location", "Connections": "connection_count", "Current": "current_count",
    "Former": "former_count", "Network URL": "linkedin_url",
}


def connection_export(people: DataFrame, person_tags: DataFrame) -> DataFrame:
    """One row per connection; tags are sorted and joined, dates carry the day only."""
    tags = person_tags.groupBy("ws", "person_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), "; ").alias("tags"))
    rows = people.join(tags, ["ws", "person_id"], "left").withColumns({
        "tags": F.coalesce("tags", F.lit("")), "connected_on": F.coalesce(iso_day(F.col("connected_at")), F.lit(""))})
    return rows.select("ws", *[F.col(c).alias(h) for h, c in CONNECTION_COLUMNS.items()])


def company_export(companies: DataFrame) -> DataFrame:
    have = set(companies.columns)
    value = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return companies.select("ws", *[value(c).alias(h) for h, c in COMPANY_COLUMNS.items()])


def guarded(export: DataFrame) -> DataFrame:
    """Every cell as text that a spreadsheet will not run as a formula."""
    return export.select("ws", *[formula_guard(F.col(c)).alias(c) for c in export.columns if c != "ws"])


def csv_lines(export: DataFrame) -> DataFrame:
    """(ws, line): quoted lines, for callers that write the text themselves."""
    cells = [csv_cell(F.col(c)) for c in export.columns if c != "ws"]
    return export.select("ws", F.concat_ws(",", *cells).alias("line"))


def write_csv(export: DataFrame, path: str, order: list) -> None:
    """One folder per workspace, rows in the given order. Workspaces are ranged, not collected."""
    ordered = guarded(export).repartitionByRange(F.col("ws"), *order).sortWithinPartitions("ws", *order)
    ordered.write.mode("overwrite").partitionBy("ws").option("header", True).option("quoteAll", True).option(
        "escape", '"').option("lineSep", "\n").csv(path)


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
