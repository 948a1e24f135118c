"""Saved segments: all evaluated together against one search each, and the stored table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_analytics import NOW, facts_of
from tieline.operators import scoring, segments as sg
from tieline.plans import segments as stored
from tieline.plans.warehouse import Warehouse

QUERIES = ['{"company":"acme"}', '{"pastCompany":"Beta "}', '{"role":"ENGINEER","recentlyMoved":true}', '{"location":"paris"}', '{"industry":"healthcare"}',
           '{"olderQuiet":true}', '{"pastCompany":"a","company":"e"}', '{}', '{"company":"  "}', '{"role":null}']
SCHEMA = "ws string, name string, description string, query string, at timestamp_ntz"
AT = dt.datetime(2026, 1, 1)


def network(spark):
    titles, firms, places = ["Staff Engineer", "Nurse", None], ["Acme", "Beta", "", None], ["Paris, France", "Lyon", None]
    people, history = [], []
    for i in range(40):
        firm = firms[i % 4]
        people.append({"person_id": f"p{i}", "current_title": titles[i % 3], "current_company": firm, "current_company_key": firm and firm.lower(), "location": places[i % 3],
                       "industry": "Hospital & Health Care" if i % 6 == 0 else None, "connected_at": dt.datetime(2010 + i % 17, 1, 1) if i % 5 else None,
                       "last_interaction_at": dt.datetime(2026, 1, 1) if i % 7 == 0 else None})
        history += [{"person_id": f"p{i}", "company_name": name, "company_key": name.lower(), "is_current": current}
                    for name, current in ((("Acme", True), ("Beta", False)) if i % 2 else (("Beta", True), ("Alpha Beta", False), ("Alpha Beta", False)))]
    return facts_of(spark, people, history)[0]


def test_together_as_one_by_one(spark):
    facts = network(spark)
    saved = spark.createDataFrame([("w", f"s{i}", q) for i, q in enumerate(QUERIES)] + [("other", "s0", QUERIES[0]), ("w", "broken", "{"), ("w", "none", None)],
                                  "ws string, segment_key string, query string")
    got = {}
    for r in sg.members(saved, facts, NOW).collect():
        assert r.ws == "w"
        got.setdefault(r.segment_key, []).append((r.person_id, r.context_score))
    for i, q in enumerate(QUERIES):
        want = scoring.find_opportunities(facts, NOW, scoring.OpportunityQuery.from_json(q), limit=1000).select("person_id", "context_score").collect()
        assert sorted(got.get(f"s{i}", [])) == sorted(map(tuple, want)), q
    assert sum(map(bool, got.values())) >= 6 and not {"broken", "none", "s7", "s8", "s9"} & got.keys()


def test_save_list_delete(spark, folder):
    house = Warehouse(spark, folder + "/w", buckets=2)
    make = lambda *rows: spark.createDataFrame([(*r, AT) for r in rows], SCHEMA)
    stored.save(house, make(("w", " Builders ", None, QUERIES[2]), ("v", "Quiet", "d", QUERIES[5])))
    stored.save(house, make(("w", "BUILDERS", "new", QUERIES[0]), ("w", "Alumni", None, QUERIES[1])))
    assert [(r.ws, r.name, r.description, r.query) for r in stored.listed(house).collect()] == [
        ("v", "Quiet", "d", QUERIES[5]), ("w", "Alumni", None, QUERIES[1]), ("w", "Builders", "new", QUERIES[0])]
    for name, query, reason in (("x", '{"shoe":1}', "unknown filter shoe"), ("", "{}", "1 to 80"), ("x" * 81, "{}", "1 to 80"), ("x", "nonsense", "no JSON"), ("x", None, "no JSON")):
        with pytest.raises(ValueError, match=reason):
            stored.save(house, make(("w", "fine", None, "{}"), ("w", name, None, query)))
    assert stored.delete(house, spark.createDataFrame([("w", " alumni"), ("w", "unknown"), ("u", "Quiet")], "ws string, name string")) == 1
    assert {(r.ws, r.name) for r in house.read("segments").collect()} == {("v", "Quiet"), ("w", "Builders")}
    assert stored.members(house, NOW).filter(F.lit(True)).count() == 0  # no people are stored
