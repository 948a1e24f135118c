"""Dashboard tables, conversation and job lists, import history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import fixed_values as fv
from tieline.operators.people import holds_text


def _per_workspace(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.groupBy("ws").agg(*aggregates)


def dashboard_totals(people: DataFrame, companies: DataFrame, messages: DataFrame, conversations: DataFrame,
                     education: DataFrame, imports: DataFrame) -> DataFrame:
    """Nine counts per workspace. `people` holds the owner too; schools count the owner's."""
    others = people.filter(~F.col("is_self"))
    # Distinct values are reduced before they are counted, so no group is gathered to find them.
    distinct = lambda df, c, name: _per_workspace(
        df.filter(c.isNotNull()).select("ws", c.alias("v")).distinct(), F.count(F.lit(1)).alias(name)
    )
    parts = [
        _per_workspace(others, F.count(F.lit(1)).alias("connections")),
        _per_workspace(companies, F.count(F.lit(1)).alias("companies"), F.count_if(F.col("current_count") > 0).alias("current_companies")),
        _per_workspace(messages, F.count(F.lit(1)).alias("messages")),
        _per_workspace(conversations, F.count(F.lit(1)).alias("conversations")),
        distinct(education, F.lower("school"), "schools"),
        distinct(others, F.col("location"), "locations"),
        distinct(others, F.col("industry"), "industries"),
        _per_workspace(imports, F.count_if(F.col("status").isin(fv.COMPLETED_STATUSES)).alias("imports"),
                       F.max(F.when(F.col("status").isin(fv.COMPLETED_STATUSES), F.col("uploaded_at"))).alias("last_import_at")),
    ]
    out = people.select("ws").distinct()
    for part in parts:
        out = out.join(part, "ws", "left")
    return out.fillna(0)


def top_companies(companies: DataFrame, limit: int = 12) -> DataFrame:
    rank = F.row_number().over(
        W.partitionBy("ws").orderBy(F.col("connection_count").desc(), F.col("name").asc(), F.col("company_id").asc())
    )
    return companies.filter("connection_count > 0").withColumn("position", rank).filter(F.col("position") <= limit).select(
        "ws", "position", "company_id", "name", "connection_count", "current_count", "former_count"
    )


def recent_connections(people: DataFrame, limit: int = 8) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.col("connected_at").desc(), F.col("person_id").asc()))
    return people.filter(F.col("connected_at").isNotNull()).withColumn("position", rank).filter(F.col("position") <= limit).select(
        "ws", "position", "person_id", "name", "current_company", "current_title", "connected_at"
    )


def recent_moves(moved: DataFrame, limit: int = 10) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.col("observed_at").desc(), F.col("person_id").asc()))
    return moved.withColumn("position", rank).filter(F.col("position") <= limit)


def onboarding(people: DataFrame, imports: DataFrame) -> DataFrame:
    known = _per_workspace(people, F.count_if(~F.col("is_self")).alias("connections"))
    runs = _per_workspace(imports, F.count(F.lit(1)).alias("imports"),
                          F.count_if(F.col("status").isin("pending", "processing")).alias("active_imports"))
    return known.join(runs, "ws", "left").fillna(0).select(
        "ws", "connections", "imports", "active_imports", (F.col("connections") > 0).alias("has_connections"),
        (F.col("imports") > 0).alias("has_imports"), (F.col("active_imports") > 0).alias("import_in_progress"),
    )


def conversation_list(conversations: DataFrame, totals: DataFrame, people: DataFrame, q: str | None = None,
                      page: int = 1, limit: int = 25) -> DataFrame:
    named = people.select("ws", "person_id", "name", "current_company", "profile_url")
    rows = conversations.join(named, ["ws", "person_id"], "left").join(totals, ["ws", "conversation_id"], "left")
    if q:
        rows = rows.filter(F.coalesce(holds_text(F.col("title"), q), F.lit(False)) | F.coalesce(holds_text(F.col("name"), q), F.lit(False)))
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.col("last_message_at").desc_nulls_last(), F.col("conversation_id").asc()))
    return (
        rows.withColumn("position", rank).filter(F.col("position") <= page * limit).filter(F.col("position") > (page - 1) * limit)
        .select("ws", "position", "conversation_id", F.coalesce("name", "title", F.lit("Conversation")).alias("title"),
                F.coalesce("message_count", F.lit(0)).alias("message_count"), "started_at", "last_message_at",
                "person_id", "current_company", "profile_url")
    )


def conversation_thread(messages: DataFrame, limit: int = 500) -> DataFrame:
    """Each conversation's first messages in time order."""
    rank = F.row_number().over(
        W.partitionBy("ws", "conversation_id").orderBy(F.col("sent_at").asc_nulls_last(), F.col("message_id").asc())
    )
    return messages.withColumn("position", rank).filter(F.col("position") <= limit)


def job_list(jobs: DataFrame, companies: DataFrame, page: int = 1, limit: int = 25) -> DataFrame:
    counted = companies.select("ws", "company_id", "connection_count")
    rank = F.row_number().over(W.partitionBy("ws").orderBy(
        F.coalesce("applied_at", "saved_at").desc_nulls_last(), F.col("title").asc(), F.col("job_id").asc()))
    wanted = jobs.withColumn("position", rank).filter(F.col("position") <= page * limit).filter(F.col("position") > (page - 1) * limit)
    return wanted.join(counted, ["ws", "company_id"], "left").select(
        "ws", "position", "job_id", "title", "company_name", "company_id",
        F.coalesce("connection_count", F.lit(0)).alias("connections_at_company"), "applied_at", "saved_at",
    )


def import_history(imports: DataFrame, files: DataFrame, page: int = 1, limit: int = 25) -> DataFrame:
    """Latest imports first, with their number of files."""
    sizes = files.groupBy("ws", "import_id").agg(F.count(F.lit(1)).alias("file_count"))
    rank = F.row_number().over(W.partitionBy("ws").orderBy(F.col("uploaded_at").desc(), F.col("import_id").desc()))
    rows = imports.withColumn("position", rank).filter(F.col("position") <= page * limit).filter(F.col("position") > (page - 1) * limit)
    return rows.join(sizes, ["ws", "import_id"], "left").fillna(0, ["file_count"])


def file_order() -> list[Column]:
    """Recognised datasets by name, then the rest by file name."""
    return [F.col("dataset").isNull().asc(), F.col("dataset").asc(), F.col("filename").asc()]


def import_detail(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Each import with its files in order: recognised datasets by name, then the rest by file name. A file's place is unique in its import;
    an upload holds at most 200 files, so the window is small."""
    place = F.row_number().over(W.partitionBy("ws", "import_id").orderBy(*file_order(), F.col("source_file").asc()))
    listed = files.withColumn("position", place).select(
        "ws", "import_id", "position", "source_file", "filename", "dataset", "file_size", F.col("status").alias("file_status"), "reason",
        F.col("records_discovered").alias("file_records"), F.col("records_imported").alias("file_imported"), F.col("records_rejected").alias("file_rejected"), "warnings", "errors")
    return imports.select("ws", "import_id", F.col("filename").alias("upload"), "uploaded_at", "status", "error_code", "error_message", "processing_completed_at").join(listed, ["ws", "import_id"], "left")
