"""Metrics on hand-built facts with exact values, and properties that must hold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tieline.operators import companies as co, concentration as con, distributions as dist, growth, merge, mobility, people as pe, scoring, signals
from tieline.operators.questions import intent_of, with_intent
from tieline.sources.facts import NetworkFacts, owner_context

NOW = "2026-09-20 12:00:00"
PEOPLE = ("ws string, person_id string, name string, current_company string, current_company_key string, current_title string, location string, industry string, "
          "profile_url string, email string, connected_at timestamp_ntz, last_interaction_at timestamp_ntz, interaction_count long, first_import_id string, last_import_id string")
JOBS = "ws string, employment_id string, person_id string, company_name string, company_key string, title string, is_current boolean, started_on date, observed_at timestamp_ntz"


def people(spark, rows):
    names = [c.split()[0] for c in PEOPLE.split(", ")]
    return spark.createDataFrame([tuple({"ws": "w", "interaction_count": 0, "name": r.get("person_id"), **r}.get(n) for n in names) for r in rows], PEOPLE)


def jobs(spark, rows):
    names = [c.split()[0] for c in JOBS.split(", ")]
    return spark.createDataFrame([tuple({"ws": "w", "employment_id": f"{i:09d}", **r}.get(n) for n in names) for i, r in enumerate(rows)], JOBS)


def companies(spark):
    return spark.createDataFrame([], "ws string, company_key string, name string")


def test_distribution_of_known_and_network(spark):
    rows = [{"person_id": f"{c}{i}", "current_company": c and f"Company {c}", "current_company_key": c and f"company {c.lower()}"}
            for c, n in (("A", 40), ("B", 30), ("C", 20), (None, 10)) for i in range(n)]
    bins = dist.current_companies(people(spark, rows), companies(spark))
    got = {r.label: (r["count"], r.known, r.total, r.share_of_known, r.share_of_network) for r in bins.collect()}
    assert got["Company A"] == (40, 90, 100, 44.4, 40.0)
    spread = con.concentration(bins).collect()[0]
    assert spread.hhi == pytest.approx((40 / 90) ** 2 + (30 / 90) ** 2 + (20 / 90) ** 2, abs=1e-8)
    assert spread.coverage_percent == 90.0 and spread.diversity_band == "high"


def test_growth_leaves_out_missing_dates(spark):
    df = people(spark, [{"person_id": "1", "connected_at": dt.datetime(2024, 1, 15)}, {"person_id": "2", "connected_at": dt.datetime(2024, 3, 20)}, {"person_id": "3"}])
    total = growth.growth_summary(df, NOW).collect()[0]
    assert (total.known, total.total, total.earliest, total.acceleration) == (2, 3, dt.datetime(2024, 1, 15), "unknown")
    series = growth.growth_series(df).orderBy("month").collect()
    assert [(r.month, r.added, r.cumulative) for r in series] == [("2024-01", 1, 1), ("2024-02", 0, 1), ("2024-03", 1, 2)]


def move_rows(n, people_count, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        who = "hot" if rng.random() < 0.4 else f"p{rng.randrange(people_count)}"
        key = rng.choice(["acme", "beta", "gamma", ""])
        start = None if rng.random() < 0.2 else dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(60))
        out.append({"person_id": who, "company_name": key.title() or None, "company_key": key or None, "title": f"t{rng.randrange(3)}", "is_current": rng.random() < 0.3,
                    "started_on": start, "observed_at": dt.datetime(2021, 1, 1 + rng.randrange(5)) if rng.random() < 0.8 else None})
    return out


def test_moves(spark):
    who = people(spark, [{"person_id": "p1", "name": "Ada"}])
    seen = lambda y: dt.datetime(y, 1, 1)
    moved = jobs(spark, [{"person_id": "p1", "company_name": "Acme", "company_key": "acme", "is_current": False, "observed_at": seen(2023)},
                         {"person_id": "p1", "company_name": "Beta", "company_key": "beta", "is_current": True, "observed_at": seen(2024)}])
    moves = mobility.career_moves(who, moved).collect()
    assert [(m.from_company, m.to_company) for m in moves] == [("Acme", "Beta")]
    assert mobility.multiple_employers(who, moved).count() == 1
    promoted = jobs(spark, [{"person_id": "p1", "company_name": "Acme", "company_key": "acme", "title": "Engineer", "is_current": False, "observed_at": seen(2023)},
                            {"person_id": "p1", "company_name": "Acme", "company_key": "acme", "title": "Senior Engineer", "is_current": True, "observed_at": seen(2024)}])
    assert mobility.career_moves(who, promoted).count() == 0
    assert mobility.career_moves(people(spark, [{"person_id": "other"}]), moved).count() == 0


def test_moves_of_hot_people_equal_plain_ones(spark):
    """Histories are windowed in segments; the result is that of one sorted list per person."""
    rows = move_rows(400, 12)
    who = people(spark, [{"person_id": p} for p in ["hot", *[f"p{i}" for i in range(12)]]])
    key = lambda df: sorted((r.person_id, r.employment_id, r.from_company, r.to_company) for r in df.collect())
    plain = key(mobility.career_moves(who, jobs(spark, rows)))
    assert plain and key(mobility.career_moves(who, jobs(spark, rows).repartition(7))) == plain
    null = dt.date.min, dt.datetime(1970, 1, 1)
    ordered = sorted(({**r, "id": f"{i:09d}"} for i, r in enumerate(rows) if r["company_key"]), key=lambda r: (
        r["person_id"], r["started_on"] or null[0], r["observed_at"] or null[1], r["is_current"], r["id"]))
    brute = sorted((b["person_id"], b["id"], a["company_name"], b["company_name"]) for a, b in zip(ordered, ordered[1:])
                   if a["person_id"] == b["person_id"] and a["company_key"] != b["company_key"])
    assert plain == brute


def test_colleagues_and_related_companies_by_brute_force(spark):
    rng = random.Random(7)
    rows, sets = [], {}
    for p in range(60):
        mine = {"big"} if rng.random() < 0.5 else set()
        mine |= {rng.choice("abcdefgh") for _ in range(rng.randrange(0, 4))}
        sets[f"p{p}"] = mine
        rows += [{"person_id": f"p{p}", "company_name": k, "company_key": k, "is_current": True} for k in mine for _ in range(2)]
    everyone = people(spark, [{"person_id": p} for p in sets]).withColumn("is_self", F.col("person_id") == "p0")
    employment = jobs(spark, rows).withColumn("company_id", F.concat(F.lit("id-"), F.col("company_key")))
    want = {p: sum(1 for q in sets if q != p and q != "p0" and sets[p] & sets[q]) for p in sets if sets[p]}
    for slot in (16_384, 12, 2):
        got = {r.person_id: r.colleagues for r in pe.colleague_counts(everyone, employment, slot).collect()}
        assert got == want, slot
    known = spark.createDataFrame([("w", k, f"id-{k}", k) for k in [*"abcdefgh", "big"]], "ws string, company_key string, company_id string, name string")
    related = {(r.company_id, r.other_name): r.shared_people for r in co.related_companies(employment, everyone, known, limit=50).collect()}
    keys = {k for s in sets.values() for k in s}
    brute = {(f"id-{x}", y): n for x in keys for y in keys if x != y and (n := sum(1 for s in sets.values() if x in s and y in s))}
    assert related == brute


def brute_related(sets, limit):
    shared = {}
    for mine in sets:
        for x in mine:
            for y in mine:
                if x != y:
                    shared.setdefault(x, {}).setdefault(y, 0)
                    shared[x][y] += 1
    return {(f"id-{x}", i + 1, f"id-{y}", n) for x, others in shared.items()
            for i, (y, n) in enumerate(sorted(others.items(), key=lambda o: (-o[1], o[0]))[:limit])}


@pytest.mark.parametrize("seed", range(4))
def test_related_companies_beside_large_sets(spark, seed):
    """Sets of many employers, some of them alone in theirs, in blocks of any size; the first few are those of all pairs."""
    rng = random.Random(seed)
    names = [f"c{i:03d}" for i in range(60)]
    sets = [set(rng.sample(names, rng.choice([1, 2, 3, 12, 30]))) for _ in range(25)]
    sets += [set(mine) for mine in sets[:8]] + [{f"only{seed}-{i}" for i in range(15)} | {names[0], names[1]}, {"x", "y"}]
    rows = [{"person_id": f"p{p}", "company_name": k, "company_key": k} for p, mine in enumerate(sets) for k in mine]
    everyone = people(spark, [{"person_id": f"p{p}"} for p in range(len(sets))]).withColumn("is_self", F.lit(False))
    known = spark.createDataFrame([("w", k, f"id-{k}", k) for k in set().union(*sets)], "ws string, company_key string, company_id string, name string")
    for limit, block in ((8, 64), (3, 5), (1, 1)):
        got = co.related_companies(jobs(spark, rows), everyone, known, limit, block).collect()
        assert {(r.company_id, r.position, r.other_id, r.shared_people) for r in got} == brute_related(sets, limit), (limit, block)


def test_related_companies_of_a_person_with_2000_employers(spark):
    """Their employers form 4 million pairs; those nobody else had meet eight others only."""
    sets = [{f"c{i:04d}" for i in range(2000)}] + [{f"c{i:04d}", f"c{i + 1:04d}"} for i in range(0, 300, 3)] + [{f"c{i:04d}", "z"} for i in range(0, 40, 2)]
    rows = [{"person_id": f"p{p}", "company_name": k, "company_key": k} for p, mine in enumerate(sets) for k in mine]
    everyone = people(spark, [{"person_id": f"p{p}"} for p in range(len(sets))]).withColumn("is_self", F.lit(False))
    known = spark.createDataFrame([("w", k, f"id-{k}", k) for k in set().union(*sets)], "ws string, company_key string, company_id string, name string")
    got = co.related_companies(jobs(spark, rows), everyone, known).collect()
    assert {(r.company_id, r.position, r.other_id, r.shared_people) for r in got} == brute_related(sets, 8)


def test_colleagues_of_a_hot_employer_and_of_a_person_with_many(spark):
    """Most people share an employer, and one person has had 40."""
    rows, sets = [], {}
    for p in range(3000):
        sets[f"p{p}"] = {"big"} if p % 10 else {f"c{p % 200}"}
    sets["p10"] = {f"c{i}" for i in range(0, 400, 10)} | {"big"}
    rows = [{"person_id": p, "company_name": k, "company_key": k, "is_current": True} for p, mine in sets.items() for k in mine]
    everyone = people(spark, [{"person_id": p} for p in sets]).withColumn("is_self", F.col("person_id") == "p20")
    holders = {}
    for p, mine in sets.items():
        for k in mine:
            holders.setdefault(k, set()).add(p)
    want = {p: len(set().union(*[holders[k] for k in mine]) - {p, "p20"}) for p, mine in sets.items()}
    for slot in (16_384, 100):
        assert {r.person_id: r.colleagues for r in pe.colleague_counts(everyone, jobs(spark, rows), slot).collect()} == want


def facts_of(spark, rows, history):
    owner = spark.createDataFrame([("w", "me", "You", None, "Berlin, Germany", "Computer Software", None)],
                                  "ws string, person_id string, name string, headline string, location string, industry string, profile_url string")
    everyone = people(spark, [*rows, {"person_id": "me"}]).withColumn("is_self", F.col("person_id") == "me")
    education = spark.createDataFrame([("w", "me", "Hillside"), ("w", "p1", "hillside")], "ws string, person_id string, school string")
    employment = jobs(spark, history)
    owners = owner.join(owner_context(everyone, employment, education), ["ws", "person_id"])
    imports = spark.createDataFrame([], "ws string, import_id string, uploaded_at timestamp_ntz, status string, had_connections boolean")
    return NetworkFacts(people(spark, rows), employment.filter("person_id <> 'me'"), education.filter("person_id <> 'me'"), companies(spark), imports, owners), everyone, education


def test_context_score_and_signals(spark):
    rows = [{"person_id": "p1", "name": "Ada", "current_company": "Acme", "current_company_key": "acme", "current_title": "Engineer", "location": "Munich, Germany",
             "industry": "Internet", "profile_url": "https://www.linkedin.com/in/ada", "connected_at": dt.datetime(2023, 1, 1)}, {"person_id": "p2", "name": "Bo"}]
    history = [{"person_id": "me", "company_key": "acme", "company_name": "Acme", "is_current": True}, {"person_id": "p1", "company_key": "acme", "company_name": "Acme", "is_current": True},
               {"person_id": "p1", "company_key": "beta", "company_name": "Beta", "is_current": False}]
    facts, everyone, education = facts_of(spark, rows, history)
    got = {r.person_id: r for r in scoring.with_context(facts, NOW).collect()}
    assert got["p1"].score == 88 and got["p2"].score == 0
    assert [c.key for c in got["p1"].contributions][:2] == ["shared_company", "shared_school"]
    assert "not relationship strength" in scoring.DISCLAIMER
    flagged = signals.with_signals(facts.people, jobs(spark, history), education, everyone, NOW)
    one = {r.person_id: r for r in flagged.withColumn("s", signals.signal_array()).collect()}
    assert one["p1"].s == ["dormant", "changed_company", "shared_company", "shared_school"] and one["p2"].s == ["no_company"]
    assert scoring.find_opportunities(facts, NOW, scoring.OpportunityQuery()).count() == 0
    assert [r.name for r in scoring.reconnection_candidates(facts, NOW).collect()] == ["Ada"]
    saved = scoring.OpportunityQuery.from_json('{"company": "acme", "recentlyMoved": true}')
    assert [r.reasons for r in scoring.find_opportunities(facts, NOW, saved).collect()] == [["Works at Acme", "More than one employer on record"]]


def test_bad_parameters_are_refused(spark):
    with pytest.raises(ValueError):
        signals.check_signal("nope")
    with pytest.raises(ValueError):
        pe.sort_order("nope")
    with pytest.raises(ValueError):
        pe.value_counts(people(spark, []), "email")


CASES = {
    "Who in my network works at OpenAI?": ("people_at_company", "openai", None), "What changed since my last import?": ("what_changed", None, None),
    "Tell me who my best friends are": ("unsupported", None, None), "how many people work in fintech": ("network_size", None, None),
    "Who formerly worked at Acme": ("people_former_company", "acme", None), "where are people based in united kingdom?": ("people_in_location", "united kingdom", None),
    "moves from Acme to Globex?": ("career_path", "acme", "globex"), "who is in healthcare": ("industry_count", "healthcare", None), "": ("unsupported", None, None),
}


def test_intents(spark):
    for question, want in CASES.items():
        assert intent_of(question) == want, question
    table = spark.createDataFrame([(q,) for q in CASES], "q string")
    assert {r.q: (r.intent, r.subject, r.target) for r in with_intent(table, F.col("q")).collect()} == CASES


def test_merge_is_idempotent(spark):
    schema = "k string, a string, b int"
    stored = spark.createDataFrame([("1", "x", 1), ("2", None, 2)], schema)
    batch = spark.createDataFrame([("2", "y", None), ("3", "z", 3)], schema)
    rules = {"a": merge.PREFER_NEW, "b": merge.PREFER_OLD}
    once = merge.merge_rows(stored, batch, ["k"], rules)
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("1", "x", 1, False), ("2", "y", 2, False), ("3", "z", 3, True)]
    twice = merge.merge_rows(once.drop("inserted"), batch, ["k"], rules)
    assert sorted(tuple(r)[:3] for r in twice.collect()) == [r[:3] for r in rows]
    with pytest.raises(ValueError):
        merge.merge_rows(stored, batch, ["k"], {"a": "nope"})


def test_underrepresented_needs_enough_known(spark):
    rows = [{"person_id": f"{t}{i}", "current_title": t} for t, n in (("Engineer", 20), ("Recruiter", 10), ("Designer", 12), ("CEO", 1)) for i in range(n)]
    bins = dist.role_families(people(spark, rows))
    assert [r.key for r in dist.underrepresented(bins).collect()] == ["leadership"]
    assert dist.underrepresented(bins, min_known=100).count() == 0
