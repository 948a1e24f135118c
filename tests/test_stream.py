"""Imports as files arrive, removal of an import, exports and user-authored tables."""

import os

import exports as ex
from pyspark.sql import functions as F

from tieline.operators import exports as out, maintenance as mt
from tieline.plans.import_job import derive
from tieline.plans.warehouse import Warehouse, delete_import, reset_workspaces
from tieline.streaming.incremental import import_stream


def put(folder, ws, name, content):
    os.makedirs(f"{folder}/in/{ws}", exist_ok=True)
    with open(f"{folder}/in/{ws}/{name}", "wb") as f:
        f.write(content)


def test_stream_then_removal(spark, folder):
    house = Warehouse(spark, f"{folder}/warehouse", buckets=2)
    go = lambda: import_stream(spark, f"{folder}/in", house, f"{folder}/checkpoint").awaitTermination()
    put(folder, "w1", "one.csv", ex.connections(ex.FIRST[:4]).encode())
    os.rename(f"{folder}/in/w1/one.csv", f"{folder}/in/w1/Connections.csv")
    go()
    assert house.read("people").count() == 4
    put(folder, "w1", "later.zip", ex.zipped({"Connections.csv": ex.connections(ex.SECOND[:3] + ex.SECOND[-1:]), "Profile.csv": ex.PROFILE}))
    go()
    people = {r.name: r for r in house.read("people").collect()}
    assert len(people) == 6 and people["Mara Quill"].current_company == "Globex"
    assert house.read("imports").count() == 2

    # Running derivation again changes nothing.
    before = sorted(map(str, house.read("people").collect() + house.read("companies").collect()))
    derive(house, house.read("people").select("ws").distinct())
    assert sorted(map(str, house.read("people").collect() + house.read("companies").collect())) == before

    last = house.read("imports").orderBy(F.col("uploaded_at").desc()).limit(1).select("ws", "import_id")
    last = spark.createDataFrame(last.collect(), last.schema)
    assert delete_import(house, last, with_data=True) == 2
    names = {r.name for r in house.read("people").collect()}
    assert "Rolf Eng" not in names and "Robin Vale" not in names and len(names) == 4
    assert house.read("imports").count() == 1
    reset_workspaces(house, spark.createDataFrame([("w1",)], "ws string"), "DELETE")
    assert house.read("people").count() == 0 and house.read("companies").count() == 0


def test_exports_are_guarded(spark, folder):
    rows = spark.createDataFrame([("w", "p1", "=cmd|calc!A1", 'say "hi"')], "ws string, person_id string, name string, current_title string")
    for c in ("first_name", "last_name", "current_company", "location", "industry", "email", "profile_url"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("connected_at", F.expr("TIMESTAMP_NTZ'2024-03-05 10:00:00'")).withColumn("interaction_count", F.lit(2))
    tags = spark.createDataFrame([("w", "p1", "mentor"), ("w", "p1", "alumni")], "ws string, person_id string, tag string")
    out.write_csv(out.connection_export(rows, tags), f"{folder}/csv", ["Name"])
    text = spark.read.text(f"{folder}/csv").select("value").collect()
    assert [r[0] for r in text][1].startswith('"\'=cmd|calc!A1"') and '"2024-03-05","2","alumni; mentor"' in text[1][0] and '"say ""hi"""' in text[1][0]


def test_tags(spark):
    schema = "ws string, person_id string, tag string, position int"
    given = spark.createDataFrame([("w", "p1", "mentor", 0), ("w", "p1", "Mentor", 1), ("w", "p1", "alumni", 2)], schema)
    assert sorted(r.tag for r in mt.dedupe_tags(given).collect()) == ["alumni", "mentor"]
    held = spark.createDataFrame([("w", "p1", "old"), ("w", "p2", "old")], "ws string, person_id string, tag string")
    assert sorted((r.person_id, r.tag) for r in mt.replace_tags(held, given).collect()) == [("p1", "alumni"), ("p1", "mentor"), ("p2", "old")]
    tags = spark.createDataFrame([("w", "old"), ("w", "unused")], "ws string, tag string")
    assert [r.tag for r in mt.orphan_tags(tags, held).collect()] == ["unused"]
