"""User-authored tags and segments, snapshots, and taking an import back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.functions import fixed_values as fv

PERSON = ["ws", "person_id"]


def dedupe_tags(assigned: DataFrame) -> DataFrame:
    """(ws, person_id, tag): one spelling per case-folded tag, the first one given (by `position`)."""
    return (
        assigned.groupBy(*PERSON, F.lower("tag").alias("tag_key")).agg(F.min_by("tag", "position").alias("tag"))
    )


def replace_tags(person_tags: DataFrame, assigned: DataFrame) -> DataFrame:
    """Tags after the people in `assigned` got exactly the tags given; others keep theirs."""
    people = assigned.select(*PERSON).distinct()
    kept = person_tags.join(people, PERSON, "left_anti").select(*PERSON, F.lower("tag").alias("tag_key"), "tag")
    return kept.unionByName(dedupe_tags(assigned.filter(F.col("tag").isNotNull())))


def vocabulary(tags: DataFrame, assigned: DataFrame) -> DataFrame:
    """Known spellings, plus new tags under the spelling that sorts first among those given first."""
    known = tags.select("ws", F.lower("tag").alias("tag_key"), "tag")
    fresh = dedupe_tags(assigned.filter(F.col("tag").isNotNull())).groupBy("ws", "tag_key").agg(F.min("tag").alias("tag"))
    return known.unionByName(fresh.join(known.select("ws", "tag_key"), ["ws", "tag_key"], "left_anti"))


def orphan_tags(tags: DataFrame, person_tags: DataFrame) -> DataFrame:
    """Tags nobody has."""
    used = person_tags.select("ws", F.lower("tag").alias("tag_key"))
    return tags.withColumn("tag_key", F.lower("tag")).join(used, ["ws", "tag_key"], "left_anti").select("ws", "tag")


def due_snapshots(candidates: DataFrame, snapshots: DataFrame, imports: DataFrame, now: str) -> DataFrame:
    """Workspaces whose last import is newer than their last snapshot of the kind; without imports,
    those not snapshotted in the last hour."""
    hour_ago = F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL '1' HOUR")
    since = imports.groupBy("ws").agg(F.max("processing_completed_at").alias("_since"))
    fresh = (
        snapshots.join(since, "ws", "left").filter(F.col("snapshot_at") >= F.coalesce("_since", hour_ago)).select("ws", "metric_type")
    )
    return candidates.join(fresh, ["ws", "metric_type"], "left_anti")


def imported_only_by(people: DataFrame, import_ids: DataFrame) -> DataFrame:
    """People that arrived in one of the given imports and in no other."""
    only = people.filter(F.col("first_import_id") == F.col("last_import_id"))
    return only.join(import_ids.select("ws", F.col("import_id").alias("first_import_id")), ["ws", "first_import_id"], "left_semi")


def without_people(child: DataFrame, removed: DataFrame) -> DataFrame:
    return child.join(removed.select(*PERSON), PERSON, "left_anti")


def save_segment(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Segments after saving a batch (ws, name, description, query, at): one per case-folded name; the
    first spelling and creation time stay, description and query are replaced."""
    from tieline.operators.merge import KEEP, REPLACE, merge_rows

    newest = batch.groupBy("ws", F.lower(F.trim("name")).alias("segment_key")).agg(
        F.max_by(F.struct(F.trim("name").alias("name"), "description", "query", F.col("at").alias("created_at"), F.col("at").alias("updated_at")), "at").alias("s")
    ).select("ws", "segment_key", "s.*")
    rules = {"name": KEEP, "description": REPLACE, "query": REPLACE, "created_at": KEEP, "updated_at": REPLACE}
    return merge_rows(stored, newest, ["ws", "segment_key"], rules).drop("inserted")


def delete_segments(stored: DataFrame, names: DataFrame) -> DataFrame:
    keys = names.select("ws", F.lower(F.trim("name")).alias("segment_key"))
    return stored.join(keys, ["ws", "segment_key"], "left_anti")


def completed(imports: DataFrame) -> DataFrame:
    return imports.filter(F.col("status").isin(fv.COMPLETED_STATUSES))
