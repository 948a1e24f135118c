"""The stored network: versioned Parquet tables in hash buckets of the workspace.

A change reads and writes only the rows of the workspaces it touches; a failed job leaves the version before it."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tieline.operators import merge as m
from tieline.plans.versions import Files, Log

BUCKETS = 64
STAMP = {"first_import_id": m.KEEP, "last_import_id": m.REPLACE}
STAMP_TYPES = "first_import_id string, last_import_id string"


@dataclass(frozen=True)
class Table:
    """Natural key, merge rule per column, and column types."""

    keys: list[str]
    rules: dict[str, str]
    schema: str
    order: tuple[str, ...] = ()  # of the rows inside a file, so that filters pass over most of it


N, O, K, R = m.PREFER_NEW, m.PREFER_OLD, m.KEEP, m.REPLACE
TABLES = {
    "companies": Table(["ws", "company_key"], {
        "company_id": K, "name": N, "linkedin_url": N, "industry": N, "connection_count": K, "current_count": K, "former_count": K, **STAMP},
        "ws string, company_key string, company_id string, name string, linkedin_url string, industry string, connection_count long, "
        f"current_count long, former_count long, {STAMP_TYPES}"),
    "people": Table(["ws", "person_key"], {
        "person_id": K, "name": N, "first_name": N, "last_name": N, "headline": N, "location": N, "industry": N, "profile_url": N, "email": N,
        "current_company": N, "current_title": N, "connected_at": O, "is_self": m.EITHER, "confidence": m.LARGEST, "interaction_count": K,
        "last_interaction_at": K, **STAMP},
        "ws string, person_key string, person_id string, name string, first_name string, last_name string, headline string, location string, "
        "industry string, profile_url string, email string, current_company string, current_title string, connected_at timestamp_ntz, "
        f"is_self boolean, confidence int, interaction_count long, last_interaction_at timestamp_ntz, {STAMP_TYPES}"),
    "connections": Table(["ws", "person_id"], {"connected_at": O, "source_file": R, "status": R, **STAMP},
        f"ws string, person_id string, connected_at timestamp_ntz, source_file string, status string, {STAMP_TYPES}"),
    "employment": Table(["ws", "employment_id"], {
        "person_id": K, "company_name": K, "title": K, "company_id": N, "company_key": N, "description": N, "start_date": K, "end_date": N,
        "started_on": K, "ended_on": N, "is_current": R, "observed_at": R, "source_file": K, **STAMP},
        "ws string, employment_id string, person_id string, company_name string, title string, company_id string, company_key string, "
        "description string, start_date string, end_date string, started_on date, ended_on date, is_current boolean, observed_at timestamp_ntz, "
        f"source_file string, {STAMP_TYPES}"),
    "education": Table(["ws", "education_id"], {
        "person_id": K, "school": K, "degree": K, "field_of_study": K, "start_date": N, "end_date": N, "source_file": K, **STAMP},
        "ws string, education_id string, person_id string, school string, degree string, field_of_study string, start_date string, "
        f"end_date string, source_file string, {STAMP_TYPES}"),
    # Endorsements are the largest count seen, not a running sum, so a repeated import cannot inflate them.
    "skills": Table(["ws", "person_id", "skill_key"], {"skill": K, "endorsements": m.LARGEST, **STAMP},
        f"ws string, person_id string, skill_key string, skill string, endorsements long, {STAMP_TYPES}"),
    "emails": Table(["ws", "person_id", "email"], {"is_primary": m.EITHER, "source_file": K, **STAMP},
        f"ws string, person_id string, email string, is_primary boolean, source_file string, {STAMP_TYPES}"),
    "phone_numbers": Table(["ws", "person_id", "phone_number"], {"type": N, "source_file": K, **STAMP},
        f"ws string, person_id string, phone_number string, type string, source_file string, {STAMP_TYPES}"),
    "profile_fields": Table(["ws", "person_id", "field_name"], {"field_value": R, "observed_at": R, "source_file": K, **STAMP},
        f"ws string, person_id string, field_name string, field_value string, observed_at timestamp_ntz, source_file string, {STAMP_TYPES}"),
    "conversations": Table(["ws", "conversation_id"], {
        "conversation_key": K, "person_id": O, "title": O, "message_count": K, "last_message_at": K, "started_at": K, **STAMP},
        "ws string, conversation_id string, conversation_key string, person_id string, title string, message_count long, "
        f"last_message_at timestamp_ntz, started_at timestamp_ntz, {STAMP_TYPES}"),
    "messages": Table(["ws", "message_id"], {
        "conversation_id": K, "sender_id": K, "sender_name": K, "recipient_name": K, "subject": K, "content": K, "sent_at": K, "direction": K,
        "source_file": K, **STAMP},
        "ws string, message_id string, conversation_id string, sender_id string, sender_name string, recipient_name string, subject string, "
        f"content string, sent_at timestamp_ntz, direction string, source_file string, {STAMP_TYPES}"),
    "activities": Table(["ws", "external_id"], {
        "person_id": K, "activity_type": K, "content": K, "content_url": K, "created_at": K, "source_file": K, **STAMP},
        "ws string, external_id string, person_id string, activity_type string, content string, content_url string, created_at timestamp_ntz, "
        f"source_file string, {STAMP_TYPES}"),
    "jobs": Table(["ws", "job_id"], {
        "external_id": K, "company_id": N, "company_name": K, "title": K, "url": K, "applied_at": O, "saved_at": O, "source_file": K, **STAMP},
        "ws string, job_id string, external_id string, company_id string, company_name string, title string, url string, "
        f"applied_at timestamp_ntz, saved_at timestamp_ntz, source_file string, {STAMP_TYPES}"),
    "interactions": Table(["ws", "interaction_id"], {"person_id": K, "kind": K, "occurred_at": K, **STAMP},
        f"ws string, interaction_id string, person_id string, kind string, occurred_at timestamp_ntz, {STAMP_TYPES}"),
    "imports": Table(["ws", "import_id"], {
        "filename": R, "uploaded_at": R, "status": R, "error_code": R, "error_message": R, "checksum": R, "file_count": R, "records_discovered": R,
        "records_imported": R, "records_updated": R, "records_duplicate": R, "records_rejected": R, "warning_count": R, "error_count": R,
        "processing_completed_at": R},
        "ws string, import_id string, filename string, uploaded_at timestamp_ntz, status string, error_code string, error_message string, checksum string, "
        "file_count long, records_discovered long, records_imported long, records_updated long, records_duplicate long, records_rejected long, "
        "warning_count long, error_count long, processing_completed_at timestamp_ntz"),
    "import_files": Table(["ws", "import_id", "source_file"], {
        "filename": R, "dataset": R, "file_size": R, "records_discovered": R, "records_imported": R, "records_rejected": R, "status": R, "reason": R,
        "warnings": R, "errors": R},
        "ws string, import_id string, source_file string, filename string, dataset string, file_size long, records_discovered long, "
        "records_imported long, records_rejected long, status string, reason string, warnings array<string>, errors array<string>"),
    # User-authored; imports never write these.
    "tags": Table(["ws", "tag_key"], {"tag": K}, "ws string, tag_key string, tag string"),
    "person_tags": Table(["ws", "person_id", "tag_key"], {"tag": K}, "ws string, person_id string, tag_key string, tag string"),
    "segments": Table(["ws", "segment_key"], {"name": K, "description": R, "query": R, "created_at": K, "updated_at": R},
        "ws string, segment_key string, name string, description string, query string, created_at timestamp_ntz, updated_at timestamp_ntz"),
    "snapshots": Table(["ws", "snapshot_at", "metric_type"], {"metric_data": R},
        "ws string, snapshot_at timestamp_ntz, metric_type string, metric_data string"),
    # The search index, kept by imports once it has been built (plans/search_index.py).
    "postings": Table(["ws", "list", "term", "id", "row", "at"], {}, "ws string, list string, term string, id string, row string, at int", ("ws", "list", "term")),
    "posting_counts": Table(["ws", "list", "term"], {"n": R}, "ws string, list string, term string, n long", ("ws", "list", "term")),
}


def surrogate(*parts):
    """Deterministic id of a natural key."""
    return F.sha2(F.concat_ws("|", *parts), 256)


LAYOUT = threading.Lock()
MAX_FOLDERS = 8  # of a bucket; more are rewritten as one


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that this package wrote itself."""
    Files(spark).delete(folder)


class Warehouse:
    """The number of buckets is stored with the tables when the first one is written. It is read back when a warehouse is opened;
    asking for another one is an error, as rows would be sought and written in the wrong buckets.

    A change writes the rows of the workspaces it touches to a new folder and lists these workspaces, whose older rows are then passed over;
    other workspaces' files stay as they are. Changes inside `transaction()` become visible together, or not at all."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.log, self.pin = Log(spark, self.root), version
        self._open: dict | None = None
        self._lock = threading.RLock()
        held = self._layout()
        if held is not None and buckets not in (None, held):
            raise ValueError(f"{self.root} has {held} buckets, not {buckets}")
        self.buckets = held or buckets or BUCKETS

    def _layout(self) -> int | None:
        if not self.log.files.listed(self.path("_layout")):
            return None
        return self.spark.read.schema("buckets int").json(self.path("_layout")).first()["buckets"]

    def _keep_layout(self) -> None:
        with LAYOUT:  # tables are written from several threads
            held = self._layout()
            if held is None:
                self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("ignore").json(self.path("_layout"))
            elif held != self.buckets:
                raise ValueError(f"{self.root} has {held} buckets, not {self.buckets}")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def schema(self, table: str) -> T.StructType:
        return T._parse_datatype_string(TABLES[table].schema)

    def pinned(self, version: int | None = None) -> Warehouse:
        """The warehouse as of a version, the latest by default; all its tables are of that version. It cannot be written."""
        return Warehouse(self.spark, self.root, version=self.log.latest() if version is None else version)

    def _state(self) -> dict:
        if self._open is not None:
            return self._open["state"]
        return self.log.state(self.log.latest() if self.pin is None else self.pin)

    def exists(self, table: str) -> bool:
        return table in self._state()["tables"]

    @contextmanager
    def transaction(self):
        """Changes made inside are committed together at its end; where it fails, none is. Reads inside see them. May be nested."""
        if self.pin is not None:
            raise ValueError("a pinned warehouse is read-only")
        with self._lock:
            outer = self._open is None
            if outer:
                base = self.log.latest()
                self._open = {"base": base, "state": self.log.state(base), "changed": set(), "lists": [], "staged": {}}
        try:
            yield self
            if outer:
                self._compact()
                if self._open["changed"]:
                    self.log.commit(self._open["base"], self._open["state"], self._open["changed"])
        finally:
            if outer:
                self._open = None

    def bucket(self):
        return F.pmod(F.xxhash64("ws"), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        schema, lists, folders = self.schema(table), set(), {}
        for bucket, entry in self._state()["tables"].get(table, {}).items():
            if buckets is None or int(bucket) in buckets:
                for folder, seq in entry["folders"]:
                    newer = [g for g, at in entry["gone"] if at > seq]
                    folders.setdefault((folder, seq, bool(newer)), []).append(f"{self.path(table)}/{folder}/bucket={bucket}")
                lists |= {(g, at) for g, at in entry["gone"]}
        if not folders:
            # A relation known to be empty, so that merges into a table without rows need no join and no task.
            return self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).limit(0)
        parts = {False: [], True: []}
        for (_, seq, aged), paths in sorted(folders.items()):
            parts[aged].append(self.spark.read.schema(schema).parquet(*paths).withColumn("_seq", F.lit(seq)))
        live = [df.drop("_seq") for df in parts[False]]
        if parts[True]:
            gone = reduce(DataFrame.union, [self.spark.read.schema("ws string").parquet(f"{self.root}/_gone/{g}").withColumn("_gone", F.lit(at)) for g, at in sorted(lists)])
            gone = gone.groupBy("ws").agg(F.max("_gone").alias("_gone"))
            older = reduce(DataFrame.union, parts[True]).join(gone, "ws", "left").filter("_gone IS NULL OR _seq >= _gone")
            live.append(older.select(*schema.names))
        return reduce(DataFrame.union, live)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of a batch: at most as many small numbers as there are buckets."""
        return sorted(r[0] for r in batch.select("ws").distinct().select(self.bucket()).distinct().collect())

    def _write(self, table: str, rows: DataFrame) -> tuple[str, list[str]]:
        """A new folder with the rows, and its buckets. Writers get even parts of buckets, also of one that holds most rows."""
        self._keep_layout()
        folder = uuid.uuid4().hex
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema(table).fields])
        placed = typed.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        if TABLES[table].order:
            placed = placed.sortWithinPartitions("bucket", *TABLES[table].order)
        placed.write.partitionBy("bucket").parquet(f"{self.path(table)}/{folder}")
        return folder, [n.split("=")[1] for n, _ in self.log.files.listed(f"{self.path(table)}/{folder}") if n.startswith("bucket=")]

    def _listed(self, workspaces: DataFrame) -> tuple[str, list[str]]:
        """A stored list of workspaces, written once a transaction, and its buckets."""
        with self._lock:
            for known, name, buckets in self._open["lists"]:
                if known is workspaces:
                    return name, buckets
            name = uuid.uuid4().hex
            workspaces.select("ws").distinct().write.parquet(f"{self.root}/_gone/{name}")
            buckets = [str(b) for b in self.touched(self.spark.read.schema("ws string").parquet(f"{self.root}/_gone/{name}"))]
            self._open["lists"].append((workspaces, name, buckets))
            return name, buckets

    def _entry(self, table: str, bucket: str) -> dict:
        self._open["changed"].add((table, bucket))
        return self._open["state"]["tables"].setdefault(table, {}).setdefault(bucket, {"folders": [], "gone": []})

    def put(self, table: str, rows: DataFrame, workspaces: DataFrame) -> None:
        """Replace all rows of the workspaces (ws) by `rows`, which are theirs only."""
        with self.transaction():
            name, touched = self._listed(workspaces)
            folder, filled = self._write(table, rows)
            with self._lock:
                state = self._open["state"]
                state["seq"] += 1
                earlier = self._open["staged"].setdefault((table, name), [])
                for bucket in touched:
                    entry = self._entry(table, bucket)
                    entry["folders"] = [x for x in entry["folders"] if x[0] not in earlier] + ([[folder, state["seq"]]] if bucket in filled else [])
                    entry["gone"] = [x for x in entry["gone"] if x[0] != name] + [[name, state["seq"]]]
                earlier.append(folder)

    def replace(self, table: str, rows: DataFrame, buckets: list[int] | None = None) -> None:
        """Replace whole buckets by `rows`: those given, which may be left empty, or else those that `rows` hold."""
        with self.transaction():
            folder, filled = self._write(table, rows)
            with self._lock:
                state = self._open["state"]
                state["seq"] += 1
                for bucket in {str(b) for b in buckets or ()} | set(filled):
                    self._entry(table, bucket).update({"folders": [[folder, state["seq"]]] if bucket in filled else [], "gone": []})

    def _compact(self) -> None:
        """Rewrite changed buckets that have come to lie in many folders."""
        for table in sorted({t for t, _ in self._open["changed"]}):
            many = [int(b) for b, e in self._open["state"]["tables"][table].items() if (table, b) in self._open["changed"] and len(e["folders"]) > MAX_FOLDERS]
            if many:
                self.replace(table, self.read(table, many), many)

    def vacuum(self, keep: int = 2, older_than_hours: float = 24) -> int:
        return self.log.vacuum(self.root, keep, older_than_hours * 3600)

    def merge(self, table: str, batch: DataFrame, workspaces: DataFrame | None = None) -> None:
        """Merge a batch by natural key into the rows of its workspaces. The batch should be stored data, as it is read more than once.
        `workspaces` holds at least those of the batch; given the same frame, several changes of a transaction share one list."""
        spec = TABLES[table]
        typed = batch.select(*[
            (F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(table).fields],
            *[F.col("ord")] * ("ord" in batch.columns))
        with self.transaction():
            workspaces = batch.select("ws").distinct() if workspaces is None else workspaces
            merged = m.merge_rows(self.of(table, workspaces), typed, spec.keys, spec.rules).drop("inserted")
            self.put(table, merged, workspaces)

    def of(self, table: str, workspaces: DataFrame) -> DataFrame:
        """The rows of some workspaces."""
        buckets = [int(b) for b in self._listed(workspaces)[1]] if self._open is not None else self.touched(workspaces)
        return self.read(table, buckets).join(workspaces.select("ws").distinct(), "ws", "left_semi").select(*self.schema(table).names)

    def counts(self, table: str, imports: DataFrame) -> DataFrame:
        """(ws, import_id, created, updated) of the imports (ws, import_id): rows each made, and rows it saw again. An import's rows carry
        its id, so counting needs no bookkeeping and can be repeated."""
        rows = self.of(table, imports).withColumnRenamed("last_import_id", "import_id").join(imports.select("ws", "import_id").distinct(), ["ws", "import_id"], "left_semi")
        return rows.groupBy("ws", "import_id").agg(
            F.count_if(F.col("first_import_id") == F.col("import_id")).alias("created"),
            F.count_if(F.col("first_import_id") != F.col("import_id")).alias("updated"),
        )


PERSON_TABLES = ["connections", "employment", "education", "skills", "emails", "phone_numbers", "profile_fields", "interactions", "person_tags"]


def delete_import(warehouse: Warehouse, import_ids: DataFrame, with_data: bool) -> int:
    """Remove imports (ws, import_id); with their data, the people only they brought go too, together
    with those people's rows, and everything derived is recomputed. Returns the number of people removed."""
    from tieline.operators.maintenance import imported_only_by, without_people
    from tieline.plans.import_job import derive

    removed = 0
    workspaces = import_ids.select("ws").distinct()
    with warehouse.transaction():
        if with_data:
            path = f"{warehouse.root}/_staged/removed-{uuid.uuid4().hex}"
            imported_only_by(warehouse.of("people", workspaces), import_ids).select("ws", "person_id").write.parquet(path)
            gone = warehouse.spark.read.schema("ws string, person_id string").parquet(path)
            removed = gone.count()
            for table in ["people", *PERSON_TABLES]:
                if warehouse.exists(table):
                    warehouse.put(table, without_people(warehouse.of(table, workspaces), gone), workspaces)
            if warehouse.exists("conversations"):
                unlinked = warehouse.of("conversations", workspaces).join(gone.withColumn("_gone", F.lit(True)), ["ws", "person_id"], "left")
                warehouse.put("conversations", unlinked.withColumn("person_id", F.when(F.col("_gone").isNull(), F.col("person_id"))), workspaces)
            derive(warehouse, workspaces)
        for table in ("imports", "import_files"):
            if warehouse.exists(table):
                warehouse.put(table, warehouse.of(table, workspaces).join(import_ids, ["ws", "import_id"], "left_anti"), workspaces)
    if with_data:
        delete_folder(warehouse.spark, path)
    return removed


def reset_workspaces(warehouse: Warehouse, workspaces: DataFrame, confirm: str) -> None:
    """Erase every stored row of the given workspaces. Must be confirmed with the word DELETE. Their files go with the next vacuum."""
    if confirm != "DELETE":
        raise ValueError('pass confirm="DELETE" to erase every imported record')
    with warehouse.transaction():
        for table in TABLES:
            if warehouse.exists(table):
                warehouse.put(table, warehouse.of(table, workspaces).limit(0), workspaces)


def append_snapshots(warehouse: Warehouse, summary: DataFrame, now: str, metric_type: str = "network_report") -> None:
    """Store a report summary (one row per workspace) as JSON, for workspaces without a snapshot since
    their last import."""
    from tieline.operators.maintenance import due_snapshots

    at = F.lit(now).cast("timestamp_ntz")
    rows = summary.select("ws", at.alias("snapshot_at"), F.lit(metric_type).alias("metric_type"), F.to_json(F.struct(*summary.columns)).alias("metric_data"))
    due = due_snapshots(rows, warehouse.read("snapshots"), warehouse.read("imports"), now)
    path = f"{warehouse.root}/_staged/snapshot_rows-{uuid.uuid4().hex}"
    due.write.mode("overwrite").parquet(path)
    warehouse.merge("snapshots", warehouse.spark.read.parquet(path))
