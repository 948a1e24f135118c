"""Repeats: members of one name, long refused paths, batches with repeated keys, imports applied twice, warehouses opened again."""

import datetime as dt
import io
import os
import zipfile
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

import exports as ex
from tieline.operators import merge as m
from tieline.plans.import_job import run_import
from tieline.plans.warehouse import TABLES, Warehouse

SCHEMA = "ws string, import_id string, archive string, content binary, uploaded_at timestamp_ntz"
LONG = "a/" + "x" * 150


@lru_cache(maxsize=1)  # the ZIP holds the time it was made
def doubled():
    """A ZIP that holds Connections.csv and an endorsement file twice, and two refused members that differ after 150 characters."""
    out = io.BytesIO()
    endorsed = ex.text([
        ["Endorsement Date", "Skill Name", "Endorser First Name", "Endorser Last Name", "Endorser Public Url", "Endorsement Status"],
        ["2024-03-11 08:00:00 UTC", "Go", "Ivo", "Marsh", ex.IN + "ivomarsh", "ACCEPTED"]])
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Profile.csv", ex.PROFILE)
        for rows in (ex.FIRST[:5], ex.FIRST[5:9]):
            z.writestr("Connections.csv", ex.connections(rows))
        for _ in range(2):
            z.writestr("Endorsement_Received_Info.csv", endorsed)
        for end in ("one.zip", "two.zip"):
            z.writestr(LONG + end, b"nested")
    return out.getvalue()


def upload(spark, *imports):
    return spark.createDataFrame([("w", i, "export.zip", bytearray(doubled()), dt.datetime(2026, 2, n)) for i, n in imports], SCHEMA)


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    house = Warehouse(spark, str(tmp_path_factory.mktemp("repeats")), buckets=4)
    run_import(house, upload(spark, ("i1", 1)), "2026-03-01 00:00:00")
    return house


def state(house, table):
    return sorted(map(repr, house.read(table).select(*TABLES[table].keys, *[c for c in TABLES[table].rules if not c.endswith("_at")]).collect()))


def test_members_of_one_name_are_files_of_their_own(house):
    files = house.read("import_files").collect()
    keys = [f.source_file for f in files]
    assert len(keys) == len(set(keys)) == 7
    counts = sorted(f.records_discovered for f in files if f.filename == "Connections.csv")
    assert counts == [4, 5]
    skills = {r.skill: r.endorsements for r in house.read("skills").collect()}
    assert skills["Go"] == 2
    assert house.read("imports").first().records_discovered == sum(f.records_discovered for f in files)


def test_refused_paths_are_kept_whole(house):
    assert sum(f.source_file.endswith((LONG + "one.zip", LONG + "two.zip")) for f in house.read("import_files").collect()) == 2


def test_the_same_import_again_changes_nothing(spark, house):
    before = {t: state(house, t) for t in TABLES}
    run_import(house, upload(spark, ("i1", 1)), "2026-03-01 00:00:00")
    after = {t: state(house, t) for t in TABLES}
    assert [x for t in TABLES for x in zip(after[t], before[t], strict=True) if x[0] != x[1]] == []


def test_run_folders_go(house):
    assert not os.path.exists(house.root + "/_runs") or os.listdir(house.root + "/_runs") == []


def test_bucket_number_is_stored(spark, house):
    assert Warehouse(spark, house.root).buckets == 4
    assert Warehouse(spark, house.root).read("people").count() == house.read("people").count() > 0
    with pytest.raises(ValueError, match="4 buckets"):
        Warehouse(spark, house.root, buckets=8)


def test_batches_may_repeat_keys(spark):
    rules = {"name": m.PREFER_NEW, "kept": m.KEEP, "flag": m.EITHER, "most": m.LARGEST, "total": m.SUM}
    schema = "k string, name string, kept string, flag boolean, most long, total long"
    batch = spark.createDataFrame([("a", "x", "o", False, 3, 1), ("a", "y", "p", True, 2, 1), ("a", None, None, None, None, None), ("b", "z", "q", False, 1, 1)], schema)
    merged = m.merge_rows(batch.limit(0), batch, ["k"], rules)
    assert sorted(map(tuple, merged.drop("inserted").collect())) == [("a", "y", "p", True, 3, 2), ("b", "z", "q", False, 1, 1)]
    quiet = {c: r for c, r in rules.items() if r != m.SUM}
    once = m.merge_rows(batch.limit(0).drop("total"), batch.drop("total"), ["k"], quiet).drop("inserted")
    twice = m.merge_rows(once, batch.drop("total"), ["k"], quiet)
    assert sorted(map(tuple, twice.drop("inserted").collect())) == sorted(map(tuple, once.collect())) and twice.filter("inserted").isEmpty()


def test_whole_texts_are_imported(spark, tmp_path_factory):
    text = "".join(chr(97 + i % 26) for i in range(30_000))
    files = ex.export_files()
    files["messages.csv"] = ex.text([
        ["CONVERSATION ID", "CONVERSATION TITLE", "FROM", "SENDER PROFILE URL", "TO", "RECIPIENT PROFILE URLS", "DATE", "SUBJECT", "CONTENT", "FOLDER"],
        ["c-1", "", "Mara Quill", ex.IN + "maraquill", "Robin Vale", ex.IN + "robinvale", "2025-11-02 09:14:03 UTC", text[:900], text, "INBOX"]])
    files["Certifications.csv"] = ex.text([["Name", "Authority"], *[["Certificate number %d" % i, ""] for i in range(3000)]])
    house = Warehouse(spark, str(tmp_path_factory.mktemp("whole")), buckets=2)
    rows = [("w", "i", "export.zip", bytearray(ex.zipped(files)), dt.datetime(2026, 2, 1))]
    run_import(house, spark.createDataFrame(rows, SCHEMA), "2026-03-01 00:00:00")
    message = house.read("messages").first()
    assert message.content == text and message.subject == text[:900]
    held = house.read("profile_fields").filter(F.col("field_name") == "certifications").first().field_value
    assert held.count("; ") == 2999
