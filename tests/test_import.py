"""The import job end to end: counts, identity, repeats, later exports and failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import exports as ex
from tieline.plans.import_job import Stage, run_import
from tieline.plans.warehouse import TABLES, Warehouse

DONE = "2026-03-01 00:00:00"
SCHEMA = "ws string, import_id string, archive string, content binary, uploaded_at timestamp_ntz"


def uploads(spark, *rows):
    return spark.createDataFrame([(ws, i, name, bytearray(content), at) for ws, i, name, content, at in rows], SCHEMA)


def day(n):
    return dt.datetime(2026, 2, n)


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    """w1 gets the first export twice, w2 the first and then the second, others fail in their own ways."""
    house = Warehouse(spark, str(tmp_path_factory.mktemp("warehouse")), buckets=4)
    first, second = ex.zipped(ex.export_files()), ex.zipped(ex.export_files(ex.SECOND))
    run_import(house, uploads(
        spark,
        ("w1", "w1-1", "export.zip", first, day(1)), ("w1", "w1-2", "export.zip", first, day(2)),
        ("w2", "w2-1", "export.zip", first, day(1)), ("w2", "w2-2", "export-2.zip", second, day(2)),
        ("w3", "w3-1", "notes.txt", b"hello world", day(1)), ("w4", "w4-1", "broken.zip", first[:200], day(1)),
        ("w5", "w5-1", "Connections.csv", ex.connections(ex.FIRST[:3]).encode(), day(1)),
        ("w6", "w6-1", "export.zip", ex.zipped(ex.export_files(profile=False)), day(1)),
        ("w7", "w7-1", "wrong.zip", ex.zipped({"Ads Clicked.csv": ex.JUNK["Ads Clicked.csv"], "photo.jpg": "x"}), day(1)),
        ("w8", "w8-1", "full.zip", ex.zipped(ex.export_files(everything=True)), day(1)),
    ), DONE)
    return house


def rows(house, table, ws, *columns):
    df = house.read(table).filter(F.col("ws") == ws)
    return df.select(*columns).collect() if columns else df.collect()


def test_people_and_connections(imported):
    people = imported.read("people").filter("ws = 'w2'")
    assert people.filter("NOT is_self").count() == 13
    assert rows(imported, "people", "w1", "is_self").count((False,)) == 12
    assert len(rows(imported, "connections", "w1")) == 11
    owner = people.filter("is_self").collect()[0]
    assert (owner.name, owner.industry, owner.current_company, owner.current_title) == ("Robin Vale", "Software Development", "Globex", "VP Engineering")


def test_weak_identity_joins_the_profile(imported):
    found = [r.person_key for r in rows(imported, "people", "w1") if r.name == "Nadia Okoro"]
    assert found == ["url:nadiaokoro"]
    assert "nc:leela rao|globex" in {r.person_key for r in rows(imported, "people", "w1")}


def test_one_person_traced(imported):
    mara = [r for r in rows(imported, "people", "w1") if r.person_key == "url:maraquill"][0]
    assert (mara.first_name, mara.email, mara.current_company, mara.headline) == ("Mara", "mara@quill.example", "Acme Corp", "Senior Engineer at Acme Corp")
    assert mara.connected_at == dt.datetime(2023, 1, 1)
    assert mara.interaction_count == 3 and mara.last_interaction_at == dt.datetime(2025, 11, 2, 17, 40, 55)


def test_companies_by_key(imported):
    acme = [r for r in rows(imported, "companies", "w1") if r.company_key == "acme"][0]
    assert (acme.connection_count, acme.current_count) == (3, 3)
    later = {r.company_key: r for r in rows(imported, "companies", "w2")}
    assert later["acme"].former_count == 1 and later["globex"].current_count >= 3


def test_owner_rows_belong_to_the_owner(imported):
    owner = [r.person_id for r in rows(imported, "people", "w1") if r.is_self][0]
    for table, n in (("education", 2), ("skills", 4), ("phone_numbers", 1)):
        assert [r.person_id for r in rows(imported, table, "w1")] == [owner] * n
    assert sum(r.person_id == owner for r in rows(imported, "employment", "w1")) == 3
    skills = {r.skill: r.endorsements for r in rows(imported, "skills", "w1")}
    assert skills["Distributed Systems"] == 1 and skills["Go"] == 1 and skills["PostgreSQL"] == 0


def test_messages(imported):
    messages = rows(imported, "messages", "w1")
    assert sorted(m.direction for m in messages) == ["inbound", "inbound", "outbound"]
    talks = {r.conversation_key: r for r in rows(imported, "conversations", "w1")}
    assert talks["c-1"].message_count == 2 and talks["c-2"].title == "Intro"
    people = {r.person_id: r.name for r in rows(imported, "people", "w1")}
    assert people[talks["c-1"].person_id] == "Mara Quill"


def test_repeat_changes_nothing(imported):
    again = {r.import_id: r for r in rows(imported, "imports", "w1")}
    assert again["w1-1"].status == again["w1-2"].status == "completed"
    assert again["w1-2"].records_imported == 0 and again["w1-2"].records_duplicate > 0
    assert again["w1-1"].checksum == again["w1-2"].checksum
    for table in TABLES:
        if table not in ("imports", "import_files") and "first_import_id" in TABLES[table].rules:
            assert {r.first_import_id for r in rows(imported, table, "w1")} <= {"w1-1"}


def test_later_export(imported):
    mara = [r for r in rows(imported, "people", "w2") if r.person_key == "url:maraquill"][0]
    assert (mara.current_company, mara.current_title) == ("Globex", "Principal Engineer")
    past = sorted((r.observed_at, r.company_name, r.is_current) for r in rows(imported, "employment", "w2") if r.person_id == mara.person_id)
    assert [x[1:] for x in past] == [("Acme Corp", False), ("Globex", True)]
    hana = [r for r in rows(imported, "people", "w2") if r.name == "Hana Sato"]
    assert len(hana) == 1
    linked = [r for r in rows(imported, "connections", "w2") if r.person_id == hana[0].person_id]
    assert linked[0].connected_at == dt.datetime(2026, 2, 2)


def test_failures_are_rows(imported):
    one = lambda ws: rows(imported, "imports", ws)[0]
    assert (one("w3").status, one("w3").error_code) == ("failed", "NO_LINKEDIN_DATA")
    assert (one("w4").status, one("w4").error_code) == ("failed", "MALFORMED_ARCHIVE")
    assert (one("w7").status, one("w7").error_code) == ("failed", "NO_LINKEDIN_DATA")
    assert one("w5").status == "completed" and len(rows(imported, "people", "w5")) == 3
    assert one("w6").status == "completed" and not [r for r in rows(imported, "people", "w6") if r.is_self]


def test_file_outcomes(imported):
    files = {r.filename: r for r in rows(imported, "import_files", "w8")}
    assert files["Ads Clicked.csv"].reason.startswith("Advertising") and files[".DS_Store"].status == "skipped"
    got = files["Connections.csv"]
    assert (got.records_discovered, got.records_imported, got.status) == (12, 12, "normalized")
    assert (files["Certifications.csv"].records_imported, files["Certifications.csv"].records_rejected) == (2, 1)


def test_datasets_without_reference_fixture(imported):
    fields = {r.field_name: r.field_value for r in rows(imported, "profile_fields", "w8")}
    assert fields["certifications"] == "Cloud Basics — Northern Institute; First Aid"
    assert fields["languages"] == "French (Native); Dutch" and fields["projects"] == "Lighthouse"
    assert fields["summary"] == "Builds teams. Likes long files."
    titles = {r.title for r in rows(imported, "employment", "w8")}
    assert {"Driver (volunteer)", "Volunteer"} <= titles
    assert {r.activity_type for r in rows(imported, "activities", "w8")} == {"comment", "reaction", "share"}
    jobs = {r.title: r for r in rows(imported, "jobs", "w8")}
    assert jobs["VP Platform"].applied_at is None and jobs["Head of Infrastructure"].saved_at == dt.datetime(2026, 2, 10)


def test_report_over_the_warehouse(imported, spark, tmp_path):
    from tieline.plans.dashboard import dashboard
    from tieline.plans.report import AnalyticsReport
    from tieline.plans.warehouse import append_snapshots
    from tieline.sources.facts import facts_of

    class Tables:
        def __getattr__(self, name):
            if name.startswith("fact_"):
                raise AttributeError(name)
            return imported.read(name)

    tables = Tables()
    report = AnalyticsReport(facts_of(tables), "2026-03-01 00:00:00")
    one = {r.ws: r for r in report.summary.collect()}
    assert one["w2"].network_size == 13 and one["w2"].new_connections == 1 and one["w1"].moves == 0
    assert {r.id for r in report.insights.filter("ws = 'w2'").collect()} >= {"top-company", "growth-window", "location-coverage"}
    shown = dashboard(tables, "2026-03-01 00:00:00")
    assert {r.ws: r.connections for r in shown["totals"].collect()}["w1"] == 12
    append_snapshots(imported, report.summary, "2026-03-02 00:00:00")
    append_snapshots(imported, report.summary, "2026-03-03 00:00:00")
    assert imported.read("snapshots").filter("ws = 'w2'").count() == 1
    kept = AnalyticsReport(facts_of(tables), "2026-03-01 00:00:00", keep=Stage(spark, str(tmp_path)).keep)
    assert sorted(map(str, kept.insights.collect())) == sorted(map(str, report.insights.collect()))
    assert kept.moves.inputFiles() and all(str(tmp_path) in f for f in kept.moves.inputFiles())
