"""Tolerant scan of delimited text files: encoding, delimiter and header are found per file.

Python decodes a file and splits it into cells, nothing else; Spark spreads files over tasks. Header, keys, blank rows, surplus cells and
warnings are columns over the cells. Damaged quoting never drops a row: the reader keeps going the way spreadsheet tools do."""

from __future__ import annotations

import csv
import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import fixed_values as fv, text as t

FILE = ["ws", "import_id", "source_file", "filename"]
CELLS_SCHEMA = (
    "ws string, import_id string, source_file string, filename string, encoding string, delimiter string, problem string, "
    "chunk long, at long, head array<array<string>>, rows array<array<string>>"
)
ARROW_SCHEMA = pa.schema([
    *[(c, pa.string()) for c in (*FILE, "encoding", "delimiter", "problem")], ("chunk", pa.int64()), ("at", pa.int64()),
    ("head", pa.list_(pa.list_(pa.string()))), ("rows", pa.list_(pa.list_(pa.string()))),
])
MAX_WARNINGS = 20
HEAD_ROWS = 10
# A chunk ends after this many rows or characters, whichever comes first.
CHUNK_ROWS, CHUNK_CHARS = 5000, 4_000_000
csv.field_size_limit(2**31 - 1)


def decode(content: bytes) -> tuple[str, str]:
    if content[:2] == b"\xfe\xff":
        return content[2:].decode("utf-16-be", errors="replace"), "utf16be"
    if content[:2] == b"\xff\xfe":
        return content[2:].decode("utf-16-le", errors="replace"), "utf16le"
    return content.decode("utf-8", errors="replace").removeprefix("﻿"), "utf8"


def find_delimiter(text: str) -> str:
    """The delimiter that occurs most outside quotes on one line, then on most lines; first best wins."""
    lines = []
    for line in io.StringIO(text):
        if line.strip():
            lines.append(re.sub('"(?:[^"]|"")*("|$)', "", line.rstrip("\r\n")))
        if len(lines) == 25:
            break
    best, best_score = ",", -1
    for delimiter in fv.DELIMITERS:
        counts = [line.count(delimiter) for line in lines]
        most = max(counts, default=0)
        if most and most * 10 + counts.count(most) > best_score:
            best, best_score = delimiter, most * 10 + counts.count(most)
    return best


def read_cells(content: bytes, chunk_rows: int = CHUNK_ROWS):
    """Yields a file's cells in chunks of rows, each with the file's first rows beside it; one chunk without rows if there is no text."""
    about = {"encoding": "utf8", "delimiter": ",", "problem": None, "chunk": 0, "at": 0, "head": [], "rows": []}
    if not content:
        yield about | {"problem": "File is empty"}
        return
    text, about["encoding"] = decode(content)
    if not text.strip():
        yield about | {"problem": "File contains no data"}
        return
    about["delimiter"] = find_delimiter(text)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=about["delimiter"])
    chunk, at, rows, chars = 0, 0, [], 0
    for row in reader:
        if at + len(rows) < HEAD_ROWS:
            about["head"].append(row)
        rows.append(row)
        chars += sum(map(len, row))
        if (len(rows) >= chunk_rows or chars > CHUNK_CHARS) and at + len(rows) >= HEAD_ROWS:
            yield about | {"chunk": chunk, "at": at, "rows": rows}
            chunk, at, rows, chars = chunk + 1, at + len(rows), [], 0
    if rows:
        yield about | {"chunk": chunk, "at": at, "rows": rows}


def cells_of(files: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(ws, import_id, source_file, filename, encoding, delimiter, problem, chunk, at, head, rows): the cells of files with `content`, `at` rows into the file."""

    def read(batches):
        for batch in batches:
            for file in batch.to_pylist():
                fixed = {k: file[k] for k in FILE}
                for chunk in read_cells(file["content"] or b"", chunk_rows):
                    yield pa.RecordBatch.from_pylist([fixed | chunk], ARROW_SCHEMA)

    return files.select(*FILE, "content").mapInArrow(read, CELLS_SCHEMA)


def _tidy(rows: Column) -> Column:
    return F.transform(rows, lambda row: F.transform(row, t.clean))


def _filled(row: Column) -> Column:
    return F.exists(row, lambda cell: cell != "")


def header_row(head: Column) -> Column:
    """Number, from 1, of the first row with two or more cells, all filled, else of the first that is not blank; 0 if all are."""
    whole = F.array_position(F.transform(head, lambda row: (F.size(row) >= 2) & F.forall(row, lambda cell: cell != "")), F.lit(True))
    some = F.array_position(F.transform(head, _filled), F.lit(True))
    return F.when(whole > 0, whole).otherwise(some)


def scan_files(files: DataFrame, max_rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of all files (ws, import_id, source_file, filename, content) with their header and the rows below it that are not blank, as
    (number, cells); `before` such rows lie in the file's earlier chunks. No row cap unless one is asked for.

    Files of an import are told apart by `source_file`. An empty file, or one without text or header, is one chunk without rows."""
    chunks = cells_of(files, chunk_rows).withColumns({"head": _tidy(F.col("head")), "rows": _tidy(F.col("rows"))}).withColumn("header_at", header_row(F.col("head")))
    keys = F.transform(F.get("head", (F.col("header_at") - 1).cast("int")), t.header_key)
    below = lambda row: (F.col("header_at") > 0) & (row["number"] > F.col("header_at"))
    numbered = F.transform("rows", lambda cells, i: F.struct((F.col("at") + i + 1).alias("number"), cells.alias("cells")))
    chunks = chunks.withColumn("header_keys", F.when(F.col("header_at") > 0, keys).otherwise(F.array().cast("array<string>"))).drop("head")
    chunks = chunks.withColumn("rows", F.filter(numbered, below)).withColumn("below", F.size("rows"))
    chunks = chunks.withColumn("rows", F.filter("rows", lambda row: _filled(row["cells"]))).withColumn("_n", F.size("rows").cast("long"))
    earlier = W.partitionBy("ws", "import_id", "source_file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    room = F.col("_n") if max_rows is None else F.greatest(F.lit(0), F.least("_n", F.lit(max_rows) - F.col("before")))
    kept = F.col("rows") if max_rows is None else F.slice("rows", F.lit(1), room.cast("int"))
    full = F.when(F.col("_n") > room, F.lit(f"Row limit ({max_rows}) reached; remaining rows were not imported"))
    return chunks.select(*FILE, "encoding", "delimiter", "problem", "chunk", "header_at", "header_keys", "before",
                         kept.alias("rows"), (F.col("below") - room).alias("skipped"), full.alias("full"))


def numbered_rows(scanned: DataFrame) -> DataFrame:
    """(ws, import_id, source_file, filename, row_no, row): cells by normalised header, missing ones empty. Of equal headers the last one counts."""
    keys = F.col("header_keys")
    last = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i)))
    rows = scanned.filter(F.size("rows") > 0).withColumn("slots", last).withColumn("names", F.transform("slots", lambda i: F.get(keys, i)))
    rows = rows.select(*FILE, "before", "slots", "names", F.posexplode("rows").alias("place", "held"))
    values = F.transform("slots", lambda i: F.coalesce(F.get(F.col("held.cells"), i), F.lit("")))
    return rows.select(*FILE, (F.col("before") + F.col("place") + 1).alias("row_no"), F.map_from_arrays("names", values).alias("row"))


def file_summaries(scanned: DataFrame) -> DataFrame:
    """One row per file: how it was read, its header, counts of rows, warnings (the first 20) and errors."""
    width = F.size("header_keys")
    wide = F.transform(
        F.slice(F.filter("rows", lambda row: F.size(row["cells"]) > width), 1, MAX_WARNINGS),
        lambda row: F.format_string("Row %d has %d columns but the header has %d; extra columns ignored", row["number"], F.size(row["cells"]), width))
    files = scanned.withColumn("wide", F.struct("chunk", wide.alias("said"))).groupBy(*FILE).agg(
        *[F.first(c).alias(c) for c in ("delimiter", "encoding", "header_keys", "header_at", "problem")], F.sum(F.size("rows")).alias("row_count"),
        F.sum("skipped").alias("skipped_rows"), F.max("full").alias("full"), F.sort_array(F.collect_list("wide")).alias("wide"))
    said = F.concat(
        F.when(F.col("header_at") > 1, F.array(F.format_string("Skipped %d preamble line(s) before the header", F.col("header_at") - 1))).otherwise(F.array()),
        F.flatten(F.transform("wide", lambda c: c["said"])), F.array_compact(F.array("full")))
    error = F.coalesce("problem", F.when(F.col("header_at") == 0, "No header row found"))
    many = F.concat(F.slice("said", 1, MAX_WARNINGS), F.array(F.lit("… and further row warnings were suppressed")))
    return files.withColumn("said", said).select(
        *FILE, "delimiter", "encoding", "header_keys", "row_count", "skipped_rows",
        F.when(F.size("said") >= MAX_WARNINGS, many).otherwise(F.col("said")).alias("warnings"),
        F.array_compact(F.array(error)).alias("errors"))


def delimiter_of(sample: Column, lines_seen: int = 25) -> Column:
    """The same choice as a Column, for text that already is one: at most 25 lines are scored."""
    lines = F.slice(F.filter(F.split(sample, r"\r?\n"), lambda line: F.trim(line) != ""), 1, lines_seen)
    bare = F.transform(lines, lambda line: F.regexp_replace(line, r'"(?:[^"]|"")*("|$)', ""))

    def scored(counts: Column, i: int, d: str) -> Column:
        of = lambda most: F.when(most > 0, F.struct(
            (most * 10 + F.size(F.filter(counts, lambda n: n == most))).alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("d")))
        return t.let(F.array_max(counts), of)

    def by_delimiter(i: int, d: str):
        return lambda counts: scored(counts, i, d)

    def best(found: Column) -> Column:
        counts = lambda d: F.transform(found, lambda line: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))))
        every = [t.let(counts(d), by_delimiter(i, d)) for i, d in enumerate(fv.DELIMITERS)]
        return F.array_max(F.array_compact(F.array(*every)))["d"]

    return F.coalesce(t.let(bare, best), F.lit(","))
