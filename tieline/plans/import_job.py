"""The import job: uploads in, merged warehouse tables and import summaries out.

Problems with data become rows, never exceptions. Uploads of one workspace are applied in upload
order, one wave after another; within a wave all workspaces go through the same DataFrame plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tieline.functions import fixed_values as fv, text as t
from tieline.operators import identity, rollups
from tieline.operators.merge import dedupe_first
from tieline.operators.normalize import Canonical, normalize_datasets
from tieline.plans import search_index
from tieline.plans.warehouse import Warehouse, delete_folder, surrogate
from tieline.session import run_together
from tieline.sources import archive, catalogue, delimited

SCOPE = ["ws", "import_id"]


class Stage:
    """Tables of one run, written below the warehouse so that every later step reads stored data."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/_runs/{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if by:
            writer = writer.partitionBy(by)
        writer.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self) -> None:
        delete_folder(self.spark, self.root)


def scan(stage: Stage, uploads: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries without content, file summaries with dataset, raw rows by dataset)."""
    entries = stage.keep("entries", archive.archive_entries(uploads).withColumn("skip_reason", F.when(
        F.col("reject_reason").isNull() & F.col("error_code").isNull(), catalogue.skip_reason(F.col("filename"), F.col("extension")))))
    wanted = entries.filter("content IS NOT NULL AND skip_reason IS NULL").withColumn("source_file", F.concat_ws("!", "archive", "entry_path"))
    # One file per task at most; files are independent, so a large one delays nothing but itself.
    scanned = stage.keep("scanned", delimited.scan_files(wanted.repartition("source_file"), max_rows))
    files = delimited.file_summaries(scanned).withColumn("dataset", catalogue.detect_dataset(F.col("filename"), F.col("header_keys")))
    files = stage.keep("files", files.withColumn(
        "dataset", F.when((F.size("errors") == 0) | (F.col("row_count") > 0), F.col("dataset"))))
    kinds = files.filter(F.col("dataset").isNotNull()).select(*SCOPE, "source_file", "dataset")
    rows = delimited.numbered_rows(scanned).join(kinds, [*SCOPE, "source_file"])
    raw = stage.keep("raw", rows.select(*SCOPE, "source_file", "row_no", "row", "dataset"), by="dataset")
    return entries.drop("content"), files, raw


def _latest(stamp: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the import's stamps to its rows."""
    return rows.join(stamp, SCOPE).withColumns({"first_import_id": F.col("import_id"), "last_import_id": F.col("import_id")})


def persist(stage: Stage, warehouse: Warehouse, canonical: Canonical, uploads: DataFrame) -> dict[str, DataFrame]:
    """Merge a wave's canonical tables. People come first; tables that only need them go together."""
    stamp = stage.keep("stamp", uploads.groupBy(*SCOPE).agg(F.min("uploaded_at").alias("_at")))
    workspaces = stage.keep("workspaces", uploads.select("ws").distinct())
    c = F.col
    one = lambda name: canonical.tables[name][0]
    people = stage.keep("people_0", one("people"))

    companies = one("companies").withColumn("company_id", surrogate("ws", "company_key"))
    zero = {k: F.lit(0) for k in ("connection_count", "current_count", "former_count")}
    companies = _latest(stamp, companies).withColumns(zero)

    # Weak identities may belong to people stored by earlier imports.
    remap = stage.keep("remap", identity.weak_to_stored(people, warehouse.of("people", workspaces)))
    moved = lambda df: identity.remap_keys(df, remap).withColumn("person_id", surrogate("ws", "person_key"))
    # A weak row and the strong row it turns out to be may both be in this import; the first one stands.
    rows = dedupe_first(identity.remap_keys(people, remap), [*SCOPE, "person_key"]).withColumns({
        "person_id": surrogate("ws", "person_key"),
        "interaction_count": F.lit(0), "last_interaction_at": F.lit(None).cast("timestamp_ntz")})
    batch = stage.keep("people", _latest(stamp, rows))
    merges = {"companies": companies, "people": batch}
    known = batch.select("ws", "import_id", "person_id", "person_key", "name", "is_self")
    ids = known.select("ws", "import_id", "person_id")
    # Owner rows of imports without a profile have no person and are dropped, like any row without one.
    belongs = lambda df: df.join(ids, ["ws", "import_id", "person_id"], "left_semi")
    child = lambda name: belongs(moved(one(name)))

    merges["connections"] = _latest(stamp, dedupe_first(child("connections"), [*SCOPE, "person_id"]))

    same = {"_c": t.comparison_key(c("company_name")), "_t": t.comparison_key(c("title")), "_s": F.coalesce("start_date", F.lit(""))}
    employment = dedupe_first(child("employment").withColumns(same), [*SCOPE, "person_id", *same])
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    key = t.nullif_blank(t.company_key(c("company_name")))
    employment = employment.withColumns({
        "company_key": key}).withColumns({
        "employment_id": surrogate("ws", "person_id", low(c("company_name")), low(c("title")), F.coalesce("start_date", F.lit(""))),
        "company_id": F.when(c("company_key").isNotNull(), surrogate("ws", "company_key"))})
    merges["employment"] = _latest(stamp, employment).withColumn("observed_at", c("_at"))

    same = {f"_{x}": t.comparison_key(c(x)) for x in ("school", "degree", "field_of_study")}
    education = dedupe_first(child("education").withColumns(same), [*SCOPE, "person_id", *same])
    education = education.withColumn("education_id", surrogate("ws", "person_id", low(c("school")), low(c("degree")), low(c("field_of_study"))))
    merges["education"] = _latest(stamp, education)

    skills = child("skills").groupBy(*SCOPE, "person_id", F.lower("skill").alias("skill_key")).agg(
        F.min_by("skill", "ord").alias("skill"), F.sum("points").alias("endorsements"))
    merges["skills"] = _latest(stamp, skills)
    merges["emails"] = _latest(stamp, dedupe_first(child("emails"), [*SCOPE, "person_id", "email"]))
    merges["phone_numbers"] = _latest(stamp, dedupe_first(child("phone_numbers"), [*SCOPE, "person_id", "phone_number"]))
    fields = _latest(stamp, dedupe_first(child("profile_fields"), [*SCOPE, "person_id", "field_name"])).withColumn("observed_at", c("_at"))
    merges["profile_fields"] = fields

    owner = known.filter("is_self").select(*SCOPE, c("person_id").alias("owner_id"))
    activities = dedupe_first(one("activities"), [*SCOPE, "external_id"]).join(owner, SCOPE, "left").withColumn("person_id", c("owner_id"))
    merges["activities"] = _latest(stamp, activities)
    jobs = one("jobs").withColumn("company_key", t.nullif_blank(t.company_key(c("company_name")))).withColumns({
        "job_id": surrogate("ws", "external_id"), "company_id": F.when(c("company_key").isNotNull(), surrogate("ws", "company_key"))})
    merges["jobs"] = _latest(stamp, jobs)

    touched = child("interactions").withColumn("interaction_id", surrogate(
        "ws", "person_id", "kind", F.coalesce(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("undated"))))
    merges["interactions"] = _latest(stamp, dedupe_first(touched, [*SCOPE, "interaction_id"]))
    run_together(warehouse.spark, *[lambda n=n, df=df: warehouse.merge(n, df, workspaces) for n, df in merges.items()])

    stored = warehouse.of("people", workspaces)
    talks = identity.resolve_counterparts(one("conversations"), stored).withColumn("conversation_id", surrogate("ws", "conversation_key"))
    talks = stage.keep("conversations", _latest(stamp, talks).withColumn("message_count", F.lit(0)))
    warehouse.merge("conversations", talks, workspaces)
    other = talks.select(*SCOPE, "conversation_key", "conversation_id", c("person_id").alias("other_id"))
    messages = one("messages").join(other, [*SCOPE, "conversation_key"]).join(owner, SCOPE, "left").withColumns({
        "sender_id": F.when(c("direction") == "outbound", c("owner_id")).otherwise(c("other_id")), "message_id": surrogate("ws", "external_id")})
    warehouse.merge("messages", _latest(stamp, dedupe_first(messages, [*SCOPE, "message_id"])), workspaces)

    return {"stamp": stamp, "workspaces": workspaces}


def derive(warehouse: Warehouse, workspaces: DataFrame) -> None:
    """Recompute everything derived of the workspaces (ws), others' rows and files stay; running it again changes nothing."""
    with warehouse.transaction():
        _derive(warehouse, workspaces)


def _derive(warehouse: Warehouse, workspaces: DataFrame) -> None:
    read = lambda table: warehouse.of(table, workspaces)
    linked = rollups.link_employment(read("employment"), read("companies"))
    talks = read("conversations").drop("message_count", "last_message_at", "started_at").join(
        rollups.conversation_totals(read("messages")), ["ws", "conversation_id"], "left").fillna(0, ["message_count"])
    run_together(warehouse.spark, lambda: warehouse.put("employment", rollups.retire_snapshots(linked), workspaces),
                 lambda: warehouse.put("conversations", talks, workspaces))
    employment, people = read("employment"), rollups.connection_dates(read("people"), read("connections"))
    totals = rollups.interaction_totals(read("conversations"), read("messages"), read("interactions"))
    role = rollups.owner_current_role(employment, people).select(
        "ws", "person_id", F.col("current_company").alias("_company"), F.col("current_title").alias("_title"), F.lit(True).alias("_has"))
    people = (
        people.drop("interaction_count", "last_interaction_at").join(totals, ["ws", "person_id"], "left").fillna(0, ["interaction_count"])
        .join(role, ["ws", "person_id"], "left")
        .withColumns({"current_company": F.when(F.col("_has"), F.col("_company")).otherwise(F.col("current_company")),
                      "current_title": F.when(F.col("_has"), F.col("_title")).otherwise(F.col("current_title"))})
    )
    bare = read("companies").drop("connection_count", "current_count", "former_count")
    counted = rollups.company_totals(bare, employment, read("people"))
    run_together(warehouse.spark, lambda: warehouse.put("companies", counted, workspaces), lambda: warehouse.put("people", people, workspaces))
    search_index.refresh(warehouse, workspaces)


def file_outcomes(entries: DataFrame, files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per file of an import: counts, status and the reason it was skipped or failed."""
    c, none = F.col, F.array().cast("array<string>")
    source = F.concat_ws("!", "archive", "entry_path")
    unread = entries.filter("error_code IS NULL AND (reject_reason IS NOT NULL OR skip_reason IS NOT NULL)").select(
        *SCOPE, source.alias("source_file"), "filename", F.lit(None).cast("string").alias("dataset"),
        F.when(c("reject_reason").isNull(), c("bytes")).otherwise(0).alias("file_size"), *[F.lit(0).cast("long").alias(x) for x in (
            "records_discovered", "records_imported", "records_rejected")], F.lit("skipped").alias("status"),
        F.coalesce("reject_reason", "skip_reason").alias("reason"), none.alias("warnings"), none.alias("errors"))
    sizes = entries.select(*SCOPE, source.alias("source_file"), c("bytes").alias("file_size"))
    counted = outcomes.select(*SCOPE, "source_file", "accepted", "rejected")
    broken = (F.size("errors") > 0) & (c("row_count") == 0)
    seen = files.join(counted, [*SCOPE, "source_file"], "left").join(sizes, [*SCOPE, "source_file"], "left")
    read = seen.select(
        *SCOPE, "source_file", "filename", "dataset", "file_size", F.when(broken, 0).otherwise(c("row_count")).alias("records_discovered"),
        F.coalesce("accepted", F.lit(0)).alias("records_imported"), F.coalesce("rejected", F.lit(0)).alias("records_rejected"),
        F.when(F.size("errors") > 0, "failed").when(c("dataset").isNull(), "skipped").otherwise("normalized").alias("status"),
        F.when(broken, c("errors")[0]).when(c("dataset").isNull(), "Not a recognised LinkedIn dataset").alias("reason"), "warnings", "errors")
    return unread.unionByName(read)


def summarise(warehouse: Warehouse, uploads: DataFrame, entries: DataFrame, outcomes: DataFrame, checksums: DataFrame, completed_at: str) -> DataFrame:
    """The imports rows: status, error code and counters."""
    c = F.col
    per = outcomes.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("records_discovered").alias("records_discovered"), F.sum("records_rejected").alias("records_rejected"),
        F.count_if(c("status") == "failed").alias("failed"), F.count(F.when(c("status") == "normalized", 1)).alias("usable"),
        F.sum(F.size("warnings")).alias("warnings"), F.sum(F.size("errors")).alias("errors"))
    fatal = entries.filter(c("error_code").isNotNull()).groupBy(*SCOPE).agg(F.min("error_code").alias("fatal"))
    out = uploads.select(*SCOPE, "filename", "uploaded_at").join(per, SCOPE, "left").join(fatal, SCOPE, "left").join(
        checksums, SCOPE, "left").fillna(0, ["file_count", "records_discovered", "records_rejected", "failed", "usable", "warnings", "errors"])
    created, updated, repeated = F.lit(0), F.lit(0), F.lit(0)
    for table in ("people", "connections", "companies", "employment", "education", "skills", "messages", "activities", "jobs"):
        counts = warehouse.counts(table, uploads).select(*SCOPE, c("created").alias(f"{table}_created"), c("updated").alias(f"{table}_updated"))
        out = out.join(counts, SCOPE, "left").fillna(0, [f"{table}_created", f"{table}_updated"])
        created = created + c(f"{table}_created")
        if table in ("people", "connections"):
            updated = updated + c(f"{table}_updated")
        if table in ("connections", "messages"):
            repeated = repeated + c(f"{table}_updated")
    code = F.coalesce("fatal", F.when(c("file_count") == 0, "NO_FILES").when(c("usable") == 0, "NO_LINKEDIN_DATA"))
    message = F.create_map(*[F.lit(x) for k, v in fv.ARCHIVE_ERRORS.items() for x in (k, v.format(n=fv.ARCHIVE_LIMITS["max_total_bytes"] // 1024 // 1024))])
    return out.withColumn("error_code", code).select(
        *SCOPE, "filename", "uploaded_at",
        F.when(c("error_code").isNotNull(), "failed").when(c("failed") > 0, "partially_completed").otherwise("completed").alias("status"),
        "error_code", F.when(c("error_code").isNotNull(), F.try_element_at(message, c("error_code"))).alias("error_message"), "checksum", "file_count",
        "records_discovered", created.alias("records_imported"), updated.alias("records_updated"), repeated.alias("records_duplicate"), "records_rejected",
        (c("warnings") + (c("failed") > 0).cast("int")).alias("warning_count"),
        (c("errors") + c("error_code").isNotNull().cast("int")).alias("error_count"), F.lit(completed_at).cast("timestamp_ntz").alias("processing_completed_at"))


def run_wave(warehouse: Warehouse, uploads: DataFrame, completed_at: str, max_rows: int | None = None) -> None:
    """Import at most one upload per workspace, as one version of the warehouse. The run's folder goes when everything is merged; a run that
    fails leaves it, and it can be deleted by hand, as later runs do not read it."""
    stage = Stage(warehouse.spark, warehouse.root)
    uploads = stage.keep("uploads", uploads)
    entries, files, raw = scan(stage, uploads, max_rows)
    together = lambda *actions: run_together(warehouse.spark, *actions)
    canonical = normalize_datasets(raw, stage.keep, together)
    outcomes = canonical.tables["outcomes"][0]
    with warehouse.transaction():
        workspaces = persist(stage, warehouse, canonical, uploads)["workspaces"]
        derive(warehouse, workspaces)
        per_file = stage.keep("import_files", file_outcomes(entries, files, outcomes))
        warehouse.merge("import_files", per_file, workspaces)
        named = uploads.withColumn("filename", F.element_at(F.split("archive", "/"), -1))
        sums = archive.upload_checksums(named)
        first = named.groupBy(*SCOPE).agg(F.min("filename").alias("filename"), F.min("uploaded_at").alias("uploaded_at"))
        warehouse.merge("imports", stage.keep("imports", summarise(warehouse, stage.keep("named", first), entries, per_file, sums, completed_at)), workspaces)
    stage.drop()


def run_import(warehouse: Warehouse, uploads: DataFrame, completed_at: str, max_rows: int | None = None) -> int:
    """Import a batch of uploads (ws, import_id, archive, content, uploaded_at); an import may hold several
    files. Imports of one workspace follow each other, so their number, not the data, bounds the waves."""
    ranked = uploads.select(*SCOPE, "uploaded_at").groupBy(*SCOPE).agg(F.min("uploaded_at").alias("uploaded_at")).withColumn(
        "wave", F.row_number().over(W.partitionBy("ws").orderBy("uploaded_at", "import_id"))).drop("uploaded_at")
    waves = ranked.agg(F.max("wave")).collect()[0][0] or 0
    for wave in range(1, waves + 1):
        now = ranked.filter(F.col("wave") == wave).select(*SCOPE)
        run_wave(warehouse, uploads.join(now, SCOPE, "left_semi"), completed_at, max_rows)
    return waves
