"""Archives, delimited files and dataset detection."""

import exports as ex
from pyspark.sql import functions as F

from tieline.sources import archive, catalogue, delimited


def parsed(spark, content, **kw):
    """(rows below the header in order, what the scan says about the file)"""
    df = spark.createDataFrame([("w", "i", "a.csv", "a.csv", bytearray(content))], "ws string, import_id string, source_file string, filename string, content binary")
    scanned = delimited.scan_files(df, **kw)
    rows = delimited.numbered_rows(scanned).orderBy("row_no").collect()
    assert [r.row_no for r in rows] == list(range(1, len(rows) + 1))
    return [r.row for r in rows], delimited.file_summaries(scanned).collect()[0].asDict()


def entries(spark, content, **kw):
    df = spark.createDataFrame([("w", "i", "a.zip", bytearray(content))], "ws string, import_id string, archive string, content binary")
    return archive.archive_entries(df, **kw).collect()


def test_preamble_and_keys(spark):
    rows, about = parsed(spark, ex.connections(ex.FIRST).encode())
    assert len(rows) == 12 and rows[0]["first name"] == "Mara" and rows[0]["connected on"] == "01 Jan 2023"
    assert about["header_keys"] == ["first name", "last name", "url", "email address", "company", "position", "connected on"]
    assert "preamble" in about["warnings"][0] and not about["errors"]


def test_damaged_rows_do_not_stop_a_file(spark):
    rows, about = parsed(spark, ex.MALFORMED.encode())
    names = [r["first name"] for r in rows]
    assert "Valid" in names and "Last" in names and "" not in names and about["skipped_rows"] == 2
    assert any("extra columns" in w for w in about["warnings"])


def test_quotes_encodings_and_limits(spark):
    assert parsed(spark, b'A,B\n"x, y","he said ""hi""\nsecond line"\n')[0] == [{"a": "x, y", "b": 'he said "hi" second line'}]
    text = "First Name,Last Name\nMara,Quill\n"
    for content, name in ((b"\xff\xfe" + text.encode("utf-16-le"), "utf16le"), (b"\xfe\xff" + text.encode("utf-16-be"), "utf16be"), (b"\xef\xbb\xbf" + text.encode(), "utf8")):
        rows, about = parsed(spark, content)
        assert rows[0]["first name"] == "Mara" and about["encoding"] == name and about["header_keys"][0] == "first name"
    assert "empty" in parsed(spark, b"")[1]["errors"][0] and "no data" in parsed(spark, b"   \n\n")[1]["errors"][0]
    assert [r["name"] for r in parsed(spark, b"Name\nGo\nSQL\n")[0]] == ["Go", "SQL"]
    rows, about = parsed(spark, ("Name\n" + "\n".join(f"n{i}" for i in range(50))).encode(), max_rows=10)
    assert len(rows) == 10 and "Row limit" in about["warnings"][0] and about["skipped_rows"] == 40


def test_rows_of_all_chunks(spark):
    """Small chunks: numbers, blank rows, surplus cells and the row limit run on from one to the next."""
    lines = ["a note", "", "N,V,N"] + [",," if i % 5 == 4 else f"x{i},{i},y{i}" + ",more" * (i % 3 == 0) for i in range(60)]
    content = "\n".join(lines).encode()
    rows, about = parsed(spark, content, chunk_rows=3)
    kept = [i for i in range(60) if i % 5 != 4]
    assert rows == [{"n": f"y{i}", "v": str(i)} for i in kept] and (about["row_count"], about["skipped_rows"]) == (48, 12)
    wide = [f"Row {i + 4} has 4 columns but the header has 3; extra columns ignored" for i in kept if i % 3 == 0]
    assert about["warnings"] == ["Skipped 2 preamble line(s) before the header", *wide] and about["errors"] == []
    rows, about = parsed(spark, content, max_rows=10, chunk_rows=3)
    assert [r["v"] for r in rows] == [str(i) for i in kept[:10]] and (about["row_count"], about["skipped_rows"]) == (10, 50)
    assert about["warnings"] == ["Skipped 2 preamble line(s) before the header", *wide[:3], "Row limit (10) reached; remaining rows were not imported"]
    rows, about = parsed(spark, ("a,b\n" + "1,2,3\n" * 50).encode())
    assert len(rows) == 50 and len(about["warnings"]) == 21 and about["warnings"][-1] == "… and further row warnings were suppressed"
    assert parsed(spark, b"\n" * 10 + b" ,\n,\n a,b\n")[1]["errors"] == ["No header row found"]


def test_delimiters(spark):
    cases = {"a;b;c\n1;2;3": ";", "a\tb\tc\n1\t2\t3": "\t", "a,b,c\n1,2,3": ",", '"a,b";c\n"1,2";3': ";", "": ",", "abc": ","}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.d for r in df.select("x", delimited.delimiter_of(F.col("x")).alias("d")).collect()} == cases
    assert {k: delimited.find_delimiter(k) for k in cases} == cases


def test_archive_guards(spark):
    rows = entries(spark, ex.zipped(ex.export_files()))
    names = {r.filename for r in rows if r.content is not None}
    assert {"Connections.csv", "Positions.csv", "Job Applications.csv"} <= names and ".DS_Store" not in names
    evil = ex.zipped({"../../../tmp/x.txt": "no", "/etc/x.txt": "no", "Connections.csv": "a,b\n1,2\n", "inner.zip": "PK"}, folder="")
    got = {r.entry_path: r.reject_reason for r in entries(spark, evil)}
    assert got["../../../tmp/x.txt"].startswith("Path traversal") and got["/etc/x.txt"].startswith("Absolute")
    assert got["Connections.csv"] is None and got["inner.zip"].startswith("Nested archives")


def test_archive_errors(spark):
    full = ex.zipped(ex.export_files())
    code = lambda content, **kw: [r.error_code for r in entries(spark, content, **kw)][-1]
    assert code(full[: len(full) // 2]) == "MALFORMED_ARCHIVE"
    assert code(b"plain", loose=False) == "INVALID_ARCHIVE" and code(b"", loose=False) == "EMPTY_ARCHIVE"
    assert code(ex.zipped({"__MACOSX/._x": "x", ".DS_Store": "y"})) == "EMPTY_ARCHIVE_CONTENTS"
    assert code(ex.zipped({"a.csv": "0" * 5000, "b.csv": "0" * 5000}), limits={"max_total_bytes": 6000}) == "ARCHIVE_BOMB"
    big = entries(spark, ex.zipped({"a.csv": "0" * 5000, "b.csv": "1"}, folder=""), limits={"max_entry_bytes": 1000})
    assert {r.entry_path: r.reject_reason is None for r in big} == {"a.csv": False, "b.csv": True}


def test_detection(spark):
    cases = [("Connections.csv", [], "connections"), ("Job Applications.csv", [], "job_applications"), ("Endorsement_Received_Info.csv", [], "endorsements_received"),
             ("export (1).csv", ["first name", "last name", "url", "email address", "company", "position", "connected on"], "connections"), ("budget.csv", ["month", "amount"], None)]
    df = spark.createDataFrame([(f, k, d) for f, k, d in cases], "f string, k array<string>, d string")
    assert all(r.got == r.d for r in df.withColumn("got", catalogue.detect_dataset(F.col("f"), F.col("k"))).collect())
    names = spark.createDataFrame([("Ads Clicked.csv",), ("Login History.csv",), ("Connections.csv",)], "f string")
    reasons = [r[0] for r in names.select(catalogue.ignored_reason(F.col("f"))).collect()]
    assert "Advertising" in reasons[0] and "telemetry" in reasons[1] and reasons[2] is None
