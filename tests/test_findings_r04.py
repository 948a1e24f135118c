"""Findings of the fourth round: the page of a person is whole."""

import datetime as dt

import duckdb

import __spark_entry__ as entry
from tieline.operators import people as pe

DAY = dt.datetime(1997, 1, 1)


def small_tables(spark, folder):
    """One workspace: owner 1, person 2 with 60 interactions and a conversation, 3 with the owner's school, 4 with nothing; 9 is nobody."""
    tables = {
        "region": ("r_regionkey long, r_name string", [(0, "W")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "FRANCE", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long, c_mktsegment string", [(i, f"Customer#{i:09d}", 0, "AUTO") for i in (1, 2, 3, 4, 7)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string", [
            (10, 1, DAY, "F", "1-URGENT"), (11, 2, DAY, "F", "2-HIGH"), (12, 2, DAY.replace(year=1999), "F", "1-URGENT"), (13, 3, DAY, "F", "2-HIGH")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [
            (10, 1, 3, 1), (11, 1, 3, 1), (11, 2, 5, 2), (12, 1, 4, 1), (13, 2, 5, 1)]),
        "part": ("p_partkey long, p_size int, p_type string", [(1, 3, "TIN"), (2, 4, "BRASS")]),
        "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string", [
            *[(i, DAY + dt.timedelta(hours=i) if i else None, 2, "click") for i in range(60)], (98, DAY, 1, "view"), (99, DAY, 9, "view")]),
        "conversations": ("conv_id long, turn int, role string, text string", [
            (2, 0, "user", "hi"), (2, 1, "assistant", "ho"), (3, 0, "system", "x"), (9, 0, "user", "who")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return tables


def test_a_profile_has_the_detail_and_all_child_rows_of_everybody(spark, folder):
    names = small_tables(spark, folder)
    got = entry.queries()["person_profile"](spark, folder)
    rows = [r.asDict() for r in got.collect()]
    of = lambda person, section: sorted((r for r in rows if (r["person_id"], r["section"]) == (person, section)), key=lambda r: r["position"])

    assert {r["person_id"] for r in rows if r["section"] == "person"} == {1, 2, 3, 4, 7}, "the owner has a page too"
    two, = of(2, "person")
    assert (two["first_name"], two["last_name"], two["location"], two["interaction_count"]) == ("Customer", "000000002", "FRANCE, CA, US", 62)
    assert (two["current_company"], two["tags"], two["colleagues"], two["shared_companies"]) == ("Okta Inc", "1-URGENT|2-HIGH", 0, "Deloitte")
    assert [(r["employment_id"], r["is_current"]) for r in of(2, "employment")] == [(12, True), (11, False)]
    assert [r["school"] for r in of(2, "education")] == ["University of FRANCE"] and len(of(7, "education")) == 1
    assert [(r["skill"], r["endorsements"]) for r in of(2, "skills")] == [("TIN", 2), ("BRASS", 1)]
    assert [(r["conversation_id"], r["title"], r["message_count"]) for r in of(2, "conversations")] == [(2, "Thread 2", 2)]
    assert [(r["title"], r["message_count"], r["last_message_at"]) for r in of(3, "conversations")] == [(None, 0, None)]
    touches = of(2, "interactions")
    assert [r["position"] for r in touches] == list(range(1, 61)), "none of 60 is left out"
    assert touches[0]["occurred_at"] == DAY + dt.timedelta(hours=59) and touches[-1]["occurred_at"] is None
    assert not [r for r in rows if r["person_id"] == 9]

    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    rel = con.execute(entry.oracle_sql()["person_profile"])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr([r[c] for c in columns]) for r in rows) == sorted(repr(list(r)) for r in rel.fetchall())


def test_sections_of_tables_with_more_columns(spark):
    """Tables of the warehouse: ends of an education and notes have an order; conversations with strangers are on no page."""
    frame = lambda rows, schema: spark.createDataFrame(rows, "ws string, person_id string, " + schema)
    person = frame([("w", "a", "A")], "name string")
    sections = pe.profile_sections(
        frame([("w", "a", "e1", None, "X", "T", "Did it", "1990", None, False, None, None, "f.csv")],
              "employment_id string, company_id string, company_name string, title string, description string, start_date string, end_date string, "
              "is_current boolean, started_on date, observed_at timestamp, source_file string"),
        frame([("w", "a", "X", "1990"), ("w", "a", "Y", None), ("w", "a", "Z", "1995")], "school string, end_date string"),
        frame([("w", "a", "c1", None), ("w", None, "c2", None), (None, "a", "c3", None)], "conversation_id string, last_message_at timestamp"),
        frame([("w", "a", "k", None, f"i{i}") for i in range(3)], "kind string, occurred_at timestamp, interaction_id string"),
        frame([("w", "a", "S", 1), ("w", "a", "R", 1), ("w", "a", "T", 5)], "skill string, endorsements int"),
        frame([("w", "a", "old", "2001"), ("w", "a", "new", "2002")], "body string, created_at string"), interaction_limit=2)
    pages = pe.profile_pages(person, sections)
    steps = pages.filter("section = 'conversations'")._jdf.queryExecution().optimizedPlan().toString()
    assert steps.index("Window") < steps.index("Filter"), "conversations with strangers go before they meet in one task"
    rows = pages.collect()
    of = lambda section, column: [r[column] for r in sorted((r for r in rows if r.section == section), key=lambda r: r.position)]
    assert of("person", "name") == ["A"] and of("education", "school") == ["Z", "X", "Y"] and of("skills", "skill") == ["T", "R", "S"]
    assert of("conversations", "conversation_id") == ["c1"] and of("notes", "body") == ["new", "old"] and of("interactions", "position") == [1, 2]
    assert of("employment", "description") == ["Did it"] and "source_file" not in rows[0] and {r.person_id for r in rows} == {"a"}
