"""Archive scan: many uploads at once, guards as columns instead of exceptions.

The only Python here opens ZIP members with the standard library, one upload per row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tieline.functions import fixed_values as fv

ENTRY_SCHEMA = (
    "ws string, import_id string, archive string, entry_path string, filename string, extension string, "
    "bytes long, content binary, reject_reason string, error_code string"
)
ARROW_SCHEMA = pa.schema([
    *[(c, pa.string()) for c in ("ws", "import_id", "archive", "entry_path", "filename", "extension")], ("bytes", pa.int64()),
    ("content", pa.binary()), ("reject_reason", pa.string()), ("error_code", pa.string()),
])
FLUSH_BYTES = 32 * 1024 * 1024


def read_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(archive, content, uploaded_at) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), "content", F.col("modificationTime").cast("timestamp_ntz").alias("uploaded_at"))


def is_zip(content):
    return F.coalesce(F.substring(content, 1, 4) == F.lit(bytearray(b"PK\x03\x04")), F.lit(False))


def reject_reason(path: str) -> str | None:
    """Why an entry's path is refused, from the path alone."""
    why = fv.ARCHIVE_REASONS
    parts = [p for p in path.split("/") if p]
    base = parts[-1] if parts else ""
    if path.startswith("/") or re.match(r"^[a-zA-Z]:", path):
        return why["absolute"]
    if ".." in parts:
        return why["traversal"]
    if len(path) > fv.ARCHIVE_LIMITS["max_path_length"]:
        return why["long"]
    if len(parts) > fv.ARCHIVE_LIMITS["max_depth"]:
        return why["deep"]
    if "__MACOSX/" in path or base.startswith("._") or base == ".DS_Store":
        return why["system"]
    if extension(base) in fv.NESTED_ARCHIVE_EXTENSIONS:
        return why["nested"]
    return None


def extension(filename: str) -> str:
    found = re.search(r"\.[^.]+$", filename)
    return found[0].lower() if found else ""


def numbered(path: str, taken: set[str]) -> str:
    """The path, with a number for the second and later members of one name, so that each member is a file of its own."""
    entry, n = path, 1
    while entry in taken:
        n += 1
        entry = f"{path}#{n}"
    taken.add(entry)
    return entry


def members(content: bytes, limits: dict[str, int]) -> Iterator[dict]:
    """Entries of one ZIP: each with content, or with the reason it was refused, or one error row."""
    if not content:
        yield {"error_code": "EMPTY_ARCHIVE"}
        return
    if content[:4] != b"PK\x03\x04":
        yield {"error_code": "INVALID_ARCHIVE"}
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in archive.infolist() if i.filename and not i.filename.replace("\\", "/").endswith("/")]
    except (zipfile.BadZipFile, ValueError, NotImplementedError, EOFError):
        yield {"error_code": "MALFORMED_ARCHIVE"}
        return
    # Sizes come from the directory; reading stops at the declared size, so a false one cannot inflate further.
    chosen, refused, total, taken = [], [], 0, set()
    for info in infos:
        path = info.filename.replace("\\", "/")
        entry = numbered(path, taken)
        reason = reject_reason(path)
        if reason is None and len(chosen) >= limits["max_entries"]:
            reason = fv.ARCHIVE_REASONS["many"].format(n=limits["max_entries"])
        if reason is None and info.file_size > limits["max_entry_bytes"]:
            reason = fv.ARCHIVE_REASONS["large"].format(n=round(limits["max_entry_bytes"] / 1024 / 1024))
        if reason is not None:
            refused.append({"entry_path": entry, "name": path, "reject_reason": reason})
            continue
        total += info.file_size
        chosen.append((entry, path, info))
    if total > limits["max_total_bytes"]:
        yield {"error_code": "ARCHIVE_BOMB"}
        return
    yield from refused
    read = 0
    for entry, path, info in chosen:
        try:
            data = archive.read(info)
        except Exception:  # a damaged member must not stop the others
            yield {"entry_path": entry, "name": path, "reject_reason": fv.ARCHIVE_REASONS["broken"]}
            continue
        read += 1
        yield {"entry_path": entry, "name": path, "content": data, "bytes": len(data)}
    if read == 0:
        yield {"error_code": "EMPTY_ARCHIVE_CONTENTS"}


def archive_entries(uploads: DataFrame, limits: dict[str, int] | None = None, loose: bool = True) -> DataFrame:
    """Entries of all uploads (ws, import_id, archive, content). With `loose`, a file that is not a ZIP
    is its own single entry; otherwise it is an error row. Output is flushed in bounded pieces."""
    bounds = {**fv.ARCHIVE_LIMITS, **(limits or {})}

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                upload = {c: batch.column(c)[row].as_py() for c in ("ws", "import_id", "archive", "content")}
                content = upload.pop("content") or b""
                held, size = [], 0
                for entry in members(content, bounds):
                    path = entry.pop("name", None)
                    name = path.rstrip("/").split("/")[-1] if path else None
                    held.append({**upload, "filename": name, "extension": extension(name) if name else None, **entry})
                    size += entry.get("bytes", 0)
                    if size >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, ARROW_SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, ARROW_SCHEMA)

    given = uploads.select("ws", "import_id", "archive", "content")
    if not loose:
        return given.mapInArrow(unpack, ENTRY_SCHEMA)
    zipped = given.filter(is_zip(F.col("content"))).mapInArrow(unpack, ENTRY_SCHEMA)
    base = F.element_at(F.split("archive", "/"), -1)
    single = given.filter(~is_zip(F.col("content"))).select(
        "ws", "import_id", "archive", F.col("archive").alias("entry_path"), base.alias("filename"),
        F.lower(F.regexp_extract(base, r"\.[^.]+$", 0)).alias("extension"), F.length("content").cast("long").alias("bytes"),
        "content", F.lit(None).cast("string").alias("reject_reason"), F.lit(None).cast("string").alias("error_code"),
    )
    return zipped.unionByName(single)


def upload_checksums(files: DataFrame) -> DataFrame:
    """(ws, import_id, checksum) over the sorted names and content digests of an upload's files."""
    digests = files.select("ws", "import_id", F.struct("filename", F.sha2("content", 256).alias("digest")).alias("f"))
    # An upload holds at most 200 files, so the gathered digests are small.
    return digests.groupBy("ws", "import_id").agg(F.sort_array(F.collect_list("f")).alias("f")).select(
        "ws", "import_id", F.sha2(F.concat_ws("", F.transform("f", lambda x: F.concat(x["filename"], x["digest"]))), 256).alias("checksum")
    )


def seen_before(checksums: DataFrame, imports: DataFrame) -> DataFrame:
    """Each upload with the latest completed import of equal checksum, if any."""
    known = imports.filter(F.col("status").isin(fv.COMPLETED_STATUSES)).groupBy("ws", "checksum").agg(
        F.max_by("import_id", F.struct("uploaded_at", "import_id")).alias("previous_import")
    )
    return checksums.join(known, ["ws", "checksum"], "left")
