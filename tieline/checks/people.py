"""Queries over signals, people lists, facets, drill-down, person and company pages."""

from pyspark.sql import functions as F

from tieline.checks import base_sql as b
from tieline.checks.careers import PAIR
from tieline.checks.composition import KEY_NOW
from tieline.checks.registry import SQL, query
from tieline.functions import fixed_values as fv, similarity as sim
from tieline.operators import companies as co, pages as pg, people as pe, rollups, signals as sg
from tieline.sources.binding import NOW
from tieline.sources.facts import facts_of

FLAGS = f""", careers AS (SELECT ws, person_id, count(DISTINCT e.company_key) > 1 AS moved, bool_or(oc.company_key IS NOT NULL) AS shared
    FROM employment_all e LEFT JOIN owner_companies oc USING (ws, company_key) WHERE e.company_key IS NOT NULL GROUP BY 1, 2),
classmates AS (SELECT DISTINCT e.ws, person_id FROM education_all e JOIN owner_schools s ON s.ws = e.ws AND s.school_key = lower(school)),
flagged AS (SELECT p.*, coalesce(connected_at >= {b.NOW} - INTERVAL 90 DAY, false) AS recent,
    coalesce(connected_at <= {b.NOW} - INTERVAL 5 YEAR, false) AS long_standing,
    coalesce(connected_at <= {b.NOW} - INTERVAL 2 YEAR AND (last_interaction_at IS NULL OR last_interaction_at <= {b.NOW} - INTERVAL 1 YEAR), false) AS dormant,
    interaction_count > 0 AS engaged, coalesce(moved, false) AS changed_company, coalesce(shared, false) AS shared_company,
    m.person_id IS NOT NULL AS shared_school, current_company IS NULL AS no_company
  FROM people p LEFT JOIN careers c USING (ws, person_id) LEFT JOIN classmates m USING (ws, person_id))"""
KEYS = ", ".join(sg.SIGNAL_KEYS)
SIGNAL_LIST = "concat_ws('|', " + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in sg.SIGNAL_KEYS) + ")"
TAG_LIST = "coalesce((SELECT string_agg(tag, '|' ORDER BY tag) FROM person_tags t WHERE t.person_id = x.person_id), '')"
joined = lambda c: F.array_join(c, "|").alias(c)


def flagged_of(tables):
    f = facts_of(tables)
    return sg.with_signals(f.people, tables.employment, tables.education, tables.people, NOW)


@query("signals", FLAGS + f" SELECT ws, person_id, {KEYS} FROM flagged")
def _signals(tables):
    return flagged_of(tables).select("ws", "person_id", *sg.SIGNAL_KEYS)


@query("signal_counts", FLAGS + " SELECT ws, key, label, kind, rule, count FROM (" + " UNION ALL ".join(
    f"SELECT ws, '{k}' AS key, {b.lit(label)} AS label, '{kind}' AS kind, {b.lit(rule)} AS rule, count(*) FILTER ({k}) AS count FROM flagged GROUP BY ws"
    for k, label, kind, rule in fv.SIGNALS) + ")")
def _signal_counts(tables):
    return sg.signal_counts(flagged_of(tables))


@query("people_signal_array", FLAGS + f" SELECT ws, person_id, {SIGNAL_LIST} AS signals, {TAG_LIST} AS tags FROM flagged x")
def _signal_array(tables):
    rows = pe.with_tags(flagged_of(tables).withColumn("signals", sg.signal_array()), tables.person_tags)
    return rows.select("ws", "person_id", joined("signals"), joined("tags"))


REASONS = "concat_ws('|', " + ", ".join(f"CASE WHEN {k} THEN {b.lit(text)} END" for k, text in fv.SUGGESTION_REASONS) + ")"


@query("reconnect_suggestions", FLAGS + f""" SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY changed_company DESC, shared_company DESC, shared_school DESC,
    connected_at ASC NULLS LAST, person_id)::INT AS position, person_id, name, current_company, current_title, profile_url, {REASONS} AS reasons, connected_at, last_interaction_at
  FROM flagged WHERE dormant OR changed_company OR shared_company OR shared_school QUALIFY position <= 20""")
def _suggest(tables):
    return sg.reconnect_suggestions(flagged_of(tables)).withColumn("reasons", F.array_join("reasons", "|"))


# --- list, filters, sorts, pages --------------------------------------------------------------

IDS = "ws, person_id, name, current_company, current_title, location, industry"
COLUMNS = IDS.split(", ")


def by_filter(name, wanted, where, extra=""):
    @query(name, FLAGS + extra + f" SELECT {IDS} FROM flagged p WHERE {where}")
    def _run(tables):
        return pe.filter_people(flagged_of(tables), wanted, tables.employment, tables.education, tables.person_tags).select(*COLUMNS)


by_filter("people_list", pe.PeopleFilter(title="engineer", location="nation", connected_after="1996-01-01", connected_before="2000-12-31", signals=["changed_company"]),
          "current_title ILIKE '%engineer%' AND location ILIKE '%nation%' AND connected_at >= TIMESTAMP '1996-01-01' AND connected_at <= TIMESTAMP '2000-12-31' AND changed_company")
by_filter("people_by_industry", pe.PeopleFilter(industry="computer SOFTWARE"), "lower(industry) = 'computer software'")
by_filter("people_at_company", pe.PeopleFilter(company="Stripe, Inc."),
          "EXISTS (SELECT 1 FROM employment_all e WHERE e.person_id = p.person_id AND is_current AND company_key = 'stripe')")
by_filter("people_formerly_at_company", pe.PeopleFilter(past_company="Nippon Systems K.K."),
          "EXISTS (SELECT 1 FROM employment_all e WHERE e.person_id = p.person_id AND NOT is_current AND company_key = 'nippon systems k k')")
by_filter("people_by_school", pe.PeopleFilter(school="open acad"), "EXISTS (SELECT 1 FROM education_all e WHERE e.person_id = p.person_id AND school ILIKE '%open acad%')")
by_filter("people_by_tag", pe.PeopleFilter(tag="1-urgent"), "EXISTS (SELECT 1 FROM person_tags t WHERE t.person_id = p.person_id AND lower(tag) = '1-urgent')")

TOKENS = lambda x: f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
GRAMS = lambda x: f"list_distinct(flatten(list_transform({TOKENS(x)}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3)))))"
SIMILAR = lambda x, y: f"(CASE WHEN len(list_distinct(list_concat({GRAMS(x)}, {GRAMS(y)}))) > 0 THEN len(list_intersect({GRAMS(x)}, {GRAMS(y)}))::DOUBLE / len(list_distinct(list_concat({GRAMS(x)}, {GRAMS(y)}))) ELSE 0 END)"
DOCUMENT = TOKENS("concat_ws(' ', name, headline, current_title, current_company, location, industry, email)")
HAS_ALL = lambda q: f"(len({TOKENS(b.lit(q))}) > 0 AND list_has_all({DOCUMENT}, {TOKENS(b.lit(q))}))"
TOKEN_RANK = lambda q: f"(CASE WHEN {HAS_ALL(q)} THEN len(list_filter({DOCUMENT}, lambda t: list_contains({TOKENS(b.lit(q))}, t)))::DOUBLE / len({DOCUMENT}) ELSE 0 END)"


def text_sql(q):
    return f"({HAS_ALL(q)} OR name ILIKE '%{q}%' OR coalesce(current_company ILIKE '%{q}%', false) OR {SIMILAR('name', b.lit(q))} > 0.3)"


@query("people_text_filter", FLAGS + f""" SELECT ws, person_id, name, round(greatest({TOKEN_RANK('deloitte engineer')}, {SIMILAR('name', b.lit('deloitte engineer'))}), 9) AS rank
  FROM flagged WHERE {text_sql('deloitte engineer')}""")
def _text(tables):
    return pe.filter_people(flagged_of(tables), pe.PeopleFilter(q="deloitte engineer")).select("ws", "person_id", "name", "rank")


@query("people_fulltext", FLAGS + f" SELECT ws, person_id, round({TOKEN_RANK('uk manager')}, 9) AS rank FROM flagged WHERE {HAS_ALL('uk manager')}")
def _fulltext(tables):
    people = facts_of(tables).people
    document, wanted = pe.search_document(people), sim.tokens(F.lit("uk manager"))
    return people.filter(sim.matches_all(document, wanted)).select("ws", "person_id", F.round(sim.token_rank(document, wanted), 9).alias("rank"))


@query("trigram_similarity", f" SELECT ws, company_key, name, round({SIMILAR('name', b.lit('Golman Saks'))}, 9) AS score, {SIMILAR('name', b.lit('Golman Saks'))} > 0.3 AS similar FROM companies")
def _trigram(tables):
    score = sim.similarity(F.col("name"), F.lit("Golman Saks"))
    return tables.companies.select("ws", "company_key", "name", F.round(score, 9).alias("score"), (score > sim.SIMILAR_ABOVE).alias("similar"))


ORDERS = {
    "name": "name", "connected_desc": "connected_at DESC NULLS LAST, name", "connected_asc": "connected_at ASC NULLS LAST, name",
    "company": "current_company ASC NULLS LAST, name", "interaction": "last_interaction_at DESC NULLS LAST, interaction_count DESC, name",
}


@query("people_sorted", FLAGS + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS sort, ws, person_id, row_number() OVER (PARTITION BY ws ORDER BY {o}, person_id)::INT AS position FROM flagged QUALIFY position <= 25" for s, o in ORDERS.items()))
def _sorted(tables):
    rows = facts_of(tables).people.withColumn("rank", F.lit(0.0))
    parts = [pe.page_of(rows, s, 1, 25).select(F.lit(s).alias("sort"), "ws", "person_id", "position") for s in ORDERS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("people_page", FLAGS + f""" SELECT ws, person_id, position, total, {SIGNAL_LIST} AS signals, {TAG_LIST} AS tags FROM (
  SELECT *, count(*) OVER (PARTITION BY ws) AS total, row_number() OVER (PARTITION BY ws ORDER BY connected_at DESC NULLS LAST, name, person_id)::INT AS position
  FROM flagged WHERE long_standing) x WHERE position BETWEEN 11 AND 20""")
def _page(tables):
    rows, total = pe.list_people(flagged_of(tables), pe.PeopleFilter(signals=["long_standing"]), tables.employment, tables.education, tables.person_tags, page=2, limit=10)
    return rows.join(total, "ws").select("ws", "person_id", "position", "total", joined("signals"), joined("tags"))


PAGE = 40
AT = "row_number() OVER (PARTITION BY ws ORDER BY {o}, person_id)"


def each_sort(tables, page):
    """`page(rows, order, starts of pages)` of every sort."""
    rows, out = facts_of(tables).people.withColumn("rank", F.lit(0.0)), None
    for sort in ORDERS:
        order = pg.people_order(sort)
        part = page(rows, order, pg.starts(rows, order, PAGE)).withColumn("sort", F.lit(sort))
        out = part if out is None else out.unionByName(part)
    return out


@query("people_page_after", FLAGS + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS sort, ws, person_id, (row_number() OVER (PARTITION BY ws ORDER BY {o}, person_id) - {2 * PAGE})::INT AS position FROM flagged QUALIFY position BETWEEN 1 AND {PAGE}"
    for s, o in ORDERS.items()))
def _page_after(tables):
    return each_sort(tables, lambda rows, order, starts: pg.after(rows, order, starts.filter("page = 3"), PAGE).select("ws", "person_id", "position"))


@query("people_page_starts", FLAGS + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS sort, ws, person_id, place // {PAGE} + 1 AS page FROM (SELECT ws, person_id, {AT.format(o=o)} AS place FROM flagged) WHERE place % {PAGE} = 0" for s, o in ORDERS.items()))
def _page_starts(tables):
    return each_sort(tables, lambda rows, order, starts: starts.select("ws", "person_id", "page"))


def counted_of(tables):
    return rollups.company_totals(tables.companies, tables.employment, tables.people)


def top_sql(facet, source, limit, extra=""):
    return f"SELECT ws, '{facet}' AS facet, row_number() OVER (PARTITION BY ws ORDER BY count DESC, value)::INT AS position, value, count FROM ({source}) QUALIFY position <= {limit}"


VALUES = lambda c: f"SELECT ws, {c} AS value, count(*) AS count FROM people WHERE {c} IS NOT NULL GROUP BY 1, 2"
SCHOOLS = "SELECT ws, school AS value, count(DISTINCT person_id) AS count FROM education GROUP BY 1, 2"
TAGS = "SELECT t.ws, t.tag AS value, count(pt.person_id) AS count FROM tags t LEFT JOIN person_tags pt USING (ws, tag) GROUP BY 1, 2"


@query("facets", " " + " UNION ALL ".join([
    top_sql("company", "SELECT ws, name AS value, current_count AS count FROM company_counts WHERE current_count > 0", 25),
    top_sql("location", VALUES("location"), 25), top_sql("industry", VALUES("industry"), 25),
    top_sql("title", VALUES("current_title"), 25), top_sql("school", SCHOOLS, 25), top_sql("tag", TAGS, 25)]))
def _facets(tables):
    f = facts_of(tables)
    return pe.facets(f.people, f.education, counted_of(tables), tables.tags, tables.person_tags)


@query("tag_counts", f" {TAGS}")
def _tags(tables):
    return pe.tag_counts(tables.tags, tables.person_tags)


@query("top_schools", f" SELECT * EXCLUDE (facet) FROM ({top_sql('school', SCHOOLS, 10)})")
def _schools(tables):
    return pe.top_per_workspace(pe.school_counts(facts_of(tables).education), 10).select("ws", "position", "value", "count")


# --- drill-down ---------------------------------------------------------------------------------

IND = ("p.industry", "p.current_title", "p.current_company")
DRILLS = {
    "company": ("stripe", f"{KEY_NOW} = 'stripe' OR lower(trim(coalesce(current_company, ''))) = 'stripe'"),
    "former_company": ("openai", "person_id IN (SELECT person_id FROM employment WHERE NOT is_current AND company_key = 'openai')"),
    "title": ("Data Scientist", "lower(trim(current_title)) = 'data scientist'"),
    "role_family": ("engineering", f"({b.role_key('current_title')}) = 'engineering'"),
    "seniority": ("senior", f"({b.seniority_key('current_title')}) = 'senior'"),
    "industry": ("healthcare", f"({b.industry_key(*IND)}) = 'healthcare'"),
    "location": ("ca, us", "contains(lower(location), 'ca, us')"),
    "city": ("nation_1", "contains(lower(location), 'nation_1')"),
    "country": ("us", "contains(lower(location), 'us')"),
    "school": ("Open Academy", "person_id IN (SELECT person_id FROM education WHERE lower(trim(school)) = 'open academy')"),
    "recent": ("", "connected_at IS NOT NULL"),
    "changed_company": ("", "person_id IN (SELECT person_id FROM employment WHERE company_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT company_key) > 1)"),
    "new_since_import": ("", "first_import_id IN (SELECT current_import FROM pair)"),
}
for _metric, (_value, _where) in DRILLS.items():
    def _drill(tables, _metric=_metric, _value=_value):
        return pe.records_for_metric(facts_of(tables), _metric, _value).select("ws", "person_id", "name", "current_company", "current_title", "location", "profile_url", "connected_at")

    query(f"drill_{_metric}", (PAIR if _metric == "new_since_import" else "") +
          f" SELECT ws, person_id, name, current_company, current_title, location, profile_url, connected_at FROM people p WHERE {_where}")(_drill)


# --- pages of one person and one company, for all of them ------------------------------------------

COLLEAGUES = """SELECT a.ws, a.person_id, count(DISTINCT b.person_id) AS colleagues FROM employment_all a
  LEFT JOIN employment b ON b.ws = a.ws AND b.company_key = a.company_key AND b.person_id <> a.person_id
  WHERE a.company_key IS NOT NULL GROUP BY 1, 2"""


@query("colleague_count", f" {COLLEAGUES}")
def _colleagues(tables):
    return pe.colleague_counts(tables.people, tables.employment)


SHARED = """SELECT DISTINCT e.ws, e.person_id, 'company' AS kind, c.name AS value FROM employment_all e JOIN owner_companies oc USING (ws, company_key) JOIN companies c USING (ws, company_key)
  UNION ALL SELECT e.ws, person_id, 'school', school FROM education_all e JOIN owner_schools s ON s.ws = e.ws AND s.school_key = lower(school)"""


@query("shared_context", f" {SHARED}")
def _shared(tables):
    return pe.shared_context(tables.people, tables.employment, tables.education, tables.companies)


DETAIL = ["name", "first_name", "last_name", "headline", "current_company", "current_title", "location", "industry", "profile_url", "email", "connected_at",
          "last_interaction_at", "interaction_count", "first_import_id"]
PLACE = "row_number() OVER (PARTITION BY ws, person_id ORDER BY {o})::INT AS position"
LATEST = lambda *columns: ", ".join(f"{c} DESC NULLS LAST" for c in columns)
SECTIONS = {
    "employment": f"""{PLACE.format(o=LATEST('is_current', 'started_on', 'observed_at', 'employment_id'))}, employment_id, company_id, company_name, title, is_current, started_on,
      observed_at FROM employment_all""",
    "education": f"{PLACE.format(o='school')}, school FROM education_all",
    "skills": f"{PLACE.format(o=LATEST('endorsements') + ', skill')}, skill, endorsements FROM ({SQL['skill_totals'].removeprefix(b.BASE)})",
    "conversations": f"""{PLACE.format(o=LATEST('last_message_at') + ', conversation_id')}, conversation_id, title, coalesce(message_count, 0) AS message_count, last_message_at
      FROM convs LEFT JOIN (SELECT conversation_id, count(*) AS message_count, max(sent_at) AS last_message_at FROM messages GROUP BY 1) USING (conversation_id)""",
    "interactions": f"{PLACE.format(o=LATEST('occurred_at', 'interaction_id'))}, kind, occurred_at FROM interactions",
}


@query("person_profile", FLAGS.replace("FROM people p", "FROM people_all p") + f""" SELECT ws, person_id, 'person' AS section, 1::INT AS position, {', '.join(DETAIL)},
  {SIGNAL_LIST} AS signals, {TAG_LIST} AS tags, coalesce(k.colleagues, 0) AS colleagues,
  coalesce((SELECT string_agg(value, '|' ORDER BY value) FROM ({SHARED}) s WHERE s.person_id = x.person_id AND s.kind = 'company'), '') AS shared_companies,
  coalesce((SELECT string_agg(DISTINCT value, '|' ORDER BY value) FROM ({SHARED}) s WHERE s.person_id = x.person_id AND s.kind = 'school'), '') AS shared_schools
  FROM flagged x LEFT JOIN ({COLLEAGUES}) k USING (ws, person_id)""" +
  "".join(f" UNION ALL BY NAME SELECT ws, person_id, '{name}' AS section, {source}" for name, source in SECTIONS.items()))
def _profile(tables):
    """Whole pages of everybody, the owners too. Interactions are all there; a page shows those up to position 50."""
    everyone = sg.with_signals(tables.people, tables.employment, tables.education, tables.people, NOW)
    rows = pe.with_tags(everyone.withColumn("signals", sg.signal_array()), tables.person_tags)
    shared = pe.shared_context(tables.people, tables.employment, tables.education, tables.companies).groupBy("ws", "person_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "company", F.col("value")))), "|").alias("shared_companies"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "school", F.col("value")))), "|").alias("shared_schools"))
    met = pe.colleague_counts(tables.people, tables.employment)
    detail = rows.join(met, ["ws", "person_id"], "left").join(shared, ["ws", "person_id"], "left").select(
        "ws", "person_id", *DETAIL, joined("signals"), joined("tags"), F.coalesce("colleagues", F.lit(0)).alias("colleagues"),
        F.coalesce("shared_companies", F.lit("")).alias("shared_companies"), F.coalesce("shared_schools", F.lit("")).alias("shared_schools"))
    skills = rollups.skill_totals(tables.endorsements).select("ws", "person_id", "skill", "endorsements")
    talks = tables.talks.select("ws", "person_id", "conversation_id", "title", "message_count", "last_message_at")
    sections = pe.profile_sections(tables.employment, tables.education, talks, tables.interactions, skills, interaction_limit=None)
    return pe.profile_pages(detail, sections)


@query("person_interactions", """ SELECT ws, person_id, row_number() OVER (PARTITION BY ws, person_id ORDER BY occurred_at DESC NULLS LAST, interaction_id DESC)::INT AS position, kind, occurred_at
  FROM interactions QUALIFY position <= 50""")
def _touches(tables):
    return pe.profile_sections(tables.employment, tables.education, tables.conversations, tables.interactions, tables.endorsements)["interactions"]


COMPANY_ROWS = "(SELECT DISTINCT ws, company_id, person_id, title FROM employment_all WHERE company_id IS NOT NULL)"


def company_top(section, source, limit):
    return f"""SELECT ws, company_id, '{section}' AS section, row_number() OVER (PARTITION BY ws, company_id ORDER BY count DESC, value)::INT AS position, value, count
      FROM (SELECT r.ws, company_id, value, count(DISTINCT r.person_id) AS count FROM {source} WHERE value IS NOT NULL GROUP BY 1, 2, 3) QUALIFY position <= {limit}"""


@query("company_profile", " " + " UNION ALL ".join([
    company_top("title", f"(SELECT r.*, r.title AS value FROM {COMPANY_ROWS} r JOIN people USING (ws, person_id)) r", 10),
    company_top("location", f"(SELECT r.*, p.location AS value FROM {COMPANY_ROWS} r JOIN people p USING (ws, person_id)) r", 10),
    company_top("school", f"(SELECT r.*, e.school AS value FROM {COMPANY_ROWS} r JOIN education_all e USING (ws, person_id)) r", 10)]))
def _company_profile(tables):
    return co.company_profile(tables.employment, tables.people, tables.education)


@query("company_people", """ SELECT e.ws, e.company_id, e.person_id, p.name, e.title, e.is_current, p.location, p.profile_url FROM employment_all e JOIN people p USING (ws, person_id)
  WHERE e.company_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY e.ws, e.company_id, e.person_id ORDER BY e.is_current DESC, e.observed_at DESC, e.employment_id DESC) = 1""")
def _company_people(tables):
    return co.company_people(tables.employment, facts_of(tables).people)


@query("related_companies", """ SELECT ws, company_id, row_number() OVER (PARTITION BY ws, company_id ORDER BY shared_people DESC, other_name, other_id)::INT AS position, other_id, other_name, shared_people
  FROM (SELECT a.ws, a.company_id, b.company_id AS other_id, c.name AS other_name, count(DISTINCT b.person_id) AS shared_people FROM employment_all a
    JOIN employment_all b ON b.person_id = a.person_id AND b.company_id <> a.company_id JOIN companies c ON c.company_id = b.company_id GROUP BY 1, 2, 3, 4) QUALIFY position <= 8""")
def _related(tables):
    return co.related_companies(tables.employment, tables.people, tables.companies)


@query("owner_worked_here", """ SELECT ws, company_id, name, EXISTS (SELECT 1 FROM employment_all e JOIN owners o USING (ws, person_id) WHERE e.company_id = c.company_id) AS self_worked_here FROM companies c""")
def _worked(tables):
    return co.owner_worked_here(tables.employment, tables.people, tables.companies).select("ws", "company_id", "name", "self_worked_here")


@query("company_list", """ SELECT ws, company_id, name, industry, connection_count, current_count, former_count,
  row_number() OVER (PARTITION BY ws ORDER BY connection_count DESC, name, company_id)::INT AS position FROM company_counts WHERE name ILIKE '%o%' QUALIFY position <= 10""")
def _company_list(tables):
    return co.list_companies(counted_of(tables), "o", limit=10).select("ws", "company_id", "name", "industry", "connection_count", "current_count", "former_count", "position")
