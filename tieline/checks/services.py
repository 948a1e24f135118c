"""Queries over dashboard, scoring, graph, lists and search."""

from pyspark.sql import functions as F

from tieline.checks import base_sql as b
from tieline.checks.careers import LATEST
from tieline.checks.people import (COMPANY_ROWS, DOCUMENT, FLAGS, HAS_ALL, IND, SCHOOLS, SIMILAR, TOKEN_RANK, VALUES, counted_of, joined, top_sql)
from tieline.checks.registry import query
from tieline.checks.composition import GEO, GEO_COLUMNS
from tieline.functions import fixed_values as fv
from tieline.operators import dashboard as da, graph as gr, mobility, pages as pg, people as pe, postings as po, rollups, scoring as sc, search as se, segments as sm
from tieline.sources.binding import NOW
from tieline.sources.facts import facts_of


@query("dashboard_totals", """ SELECT ws, (SELECT count(*) FROM people p WHERE p.ws = w.ws) AS connections, (SELECT count(*) FROM companies p WHERE p.ws = w.ws) AS companies,
  (SELECT count(*) FROM company_counts p WHERE p.ws = w.ws AND current_count > 0) AS current_companies, (SELECT count(*) FROM messages p WHERE p.ws = w.ws) AS messages,
  (SELECT count(*) FROM convs p WHERE p.ws = w.ws) AS conversations, (SELECT count(DISTINCT lower(school)) FROM education_all p WHERE p.ws = w.ws) AS schools,
  (SELECT count(DISTINCT location) FROM people p WHERE p.ws = w.ws) AS locations, (SELECT count(DISTINCT industry) FROM people p WHERE p.ws = w.ws) AS industries,
  (SELECT count(*) FROM imports p WHERE p.ws = w.ws) AS imports, (SELECT max(uploaded_at) FROM imports p WHERE p.ws = w.ws) AS last_import_at
  FROM (SELECT DISTINCT ws FROM people_all) w""")
def _totals(tables):
    return da.dashboard_totals(tables.people, counted_of(tables), tables.messages, tables.conversations, tables.education, tables.imports)


@query("top_values", " " + " UNION ALL ".join(top_sql(c, VALUES(c), 10) for c in ("current_title", "location", "industry", "current_company")))
def _tops(tables):
    people, out = facts_of(tables).people, None
    for c in ("current_title", "location", "industry", "current_company"):
        part = pe.top_per_workspace(pe.value_counts(people, c), 10).select("ws", F.lit(c).alias("facet"), "position", "value", "count")
        out = part if out is None else out.unionByName(part)
    return out


@query("top_companies", """ SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY connection_count DESC, name, company_id)::INT AS position, company_id, name,
  connection_count, current_count, former_count FROM company_counts WHERE connection_count > 0 QUALIFY position <= 12""")
def _top_companies(tables):
    return da.top_companies(counted_of(tables))


@query("recent_connections", """ SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY connected_at DESC, person_id)::INT AS position, person_id, name, current_company,
  current_title, connected_at FROM people WHERE connected_at IS NOT NULL QUALIFY position <= 8""")
def _recent(tables):
    return da.recent_connections(facts_of(tables).people)


@query("recent_moves", LATEST + " SELECT *, row_number() OVER (PARTITION BY ws ORDER BY observed_at DESC, person_id)::INT AS position FROM latest_moves QUALIFY position <= 10")
def _recent_moves(tables):
    f = facts_of(tables)
    return da.recent_moves(mobility.moved_latest(f.people, f.employment))


@query("onboarding", """ SELECT ws, connections, imports, active_imports, connections > 0 AS has_connections, imports > 0 AS has_imports, active_imports > 0 AS import_in_progress FROM
  (SELECT ws, count(*) AS connections FROM people GROUP BY ws) JOIN
  (SELECT ws, count(*) AS imports, count(*) FILTER (status IN ('pending', 'processing')) AS active_imports FROM imports_all GROUP BY ws) USING (ws)""")
def _onboarding(tables):
    return da.onboarding(tables.people, tables.imports)


TALK = "(SELECT conversation_id, count(*) AS message_count, max(sent_at) AS last_message_at, min(sent_at) AS started_at FROM messages GROUP BY 1)"


@query("conversation_list", f""" SELECT c.ws, row_number() OVER (PARTITION BY c.ws ORDER BY last_message_at DESC NULLS LAST, conversation_id)::INT AS position, conversation_id,
  coalesce(p.name, c.title, 'Conversation') AS title, coalesce(message_count, 0) AS message_count, started_at, last_message_at, c.person_id, current_company, profile_url
  FROM convs c LEFT JOIN people_all p ON p.person_id = c.person_id LEFT JOIN {TALK} t USING (conversation_id)
  WHERE coalesce(c.title ILIKE '%thread%', false) OR coalesce(p.name ILIKE '%thread%', false) QUALIFY position <= 25""")
def _conversation_list(tables):
    return da.conversation_list(tables.conversations, rollups.conversation_totals(tables.messages), tables.people, "thread")


@query("conversation_thread", """ SELECT ws, conversation_id, message_id, sent_at, direction, length(content) AS size,
  row_number() OVER (PARTITION BY ws, conversation_id ORDER BY sent_at ASC NULLS LAST, message_id)::INT AS position FROM messages QUALIFY position <= 500""")
def _thread(tables):
    return da.conversation_thread(tables.messages).select("ws", "conversation_id", "message_id", "sent_at", "direction",
                                                          F.length("content").cast("long").alias("size"), "position")


@query("job_list", """ SELECT j.ws, row_number() OVER (PARTITION BY j.ws ORDER BY coalesce(applied_at, saved_at) DESC NULLS LAST, title, job_id)::INT AS position, job_id, title, company_name,
  company_id, coalesce(connection_count, 0) AS connections_at_company, applied_at, saved_at FROM jobs j LEFT JOIN company_counts c USING (company_id) QUALIFY position <= 25""")
def _job_list(tables):
    return da.job_list(tables.jobs, counted_of(tables))


@query("import_history", """ SELECT ws, import_id, uploaded_at, status, filename, row_number() OVER (PARTITION BY ws ORDER BY uploaded_at DESC, import_id DESC)::INT AS position, 1::BIGINT AS file_count
  FROM imports_all QUALIFY position <= 5""")
def _history(tables):
    return da.import_history(tables.imports, tables.import_files, limit=5)


# --- scoring ---------------------------------------------------------------------------------------

YEARS = f"((epoch_us({b.NOW}) - epoch_us(connected_at)) / 86400e6 / 365.25)"
SELF = f""", geo AS (SELECT ws, person_id, {GEO_COLUMNS} FROM ({GEO})),
mine AS (SELECT o.ws, {b.industry_key('o.industry', 'NULL::VARCHAR', '(SELECT min(company_key) FROM owner_companies c WHERE c.ws = o.ws)')} AS self_industry FROM owners o),
self_geo AS (SELECT ws, {GEO_COLUMNS} FROM ({GEO.replace('FROM people ', 'FROM owners ')})),
jobs_of AS (SELECT e.ws, person_id, count(DISTINCT e.company_key) AS employers, count(DISTINCT oc.company_key) AS shared FROM employment e LEFT JOIN owner_companies oc USING (ws, company_key)
  WHERE e.company_key IS NOT NULL GROUP BY 1, 2),
mates AS (SELECT DISTINCT e.ws, person_id FROM education e JOIN owner_schools s ON s.ws = e.ws AND s.school_key = lower(trim(school))),
pre AS (SELECT p.*, {b.industry_key(*IND)} AS industry_key, {b.industry_label(*IND)} AS industry_label, {b.industry_trust('p.industry')} AS industry_trust, {b.industry_confidence('p.industry')} AS industry_confidence,
    g.country, sg.country AS self_country, mine.self_industry, coalesce(employers, 0) AS employers, coalesce(shared, 0) AS shared, mates.person_id IS NOT NULL AS mate, {YEARS} AS years,
    (profile_url IS NOT NULL)::INT + (current_company IS NOT NULL)::INT + (current_title IS NOT NULL)::INT + (connected_at IS NOT NULL)::INT AS complete
  FROM people p LEFT JOIN geo g USING (ws, person_id) LEFT JOIN self_geo sg ON sg.ws = p.ws LEFT JOIN mine ON mine.ws = p.ws LEFT JOIN jobs_of USING (ws, person_id) LEFT JOIN mates USING (ws, person_id)),
rules AS (SELECT *, shared > 0 AS s1, mate AS s2, coalesce(industry_key = self_industry, false) AS s3, coalesce(country = self_country, false) AS s4,
    coalesce(years >= 1 AND years < 5, false) AS s5, employers > 1 AS s6, complete >= 3 AS s7 FROM pre),
scored AS (SELECT *, s1::INT * 25 + s2::INT * 20 + s3::INT * 10 + s4::INT * 8 + s5::INT * 5 + s6::INT * 15 + s7::INT * 5 AS score FROM rules)"""
EVIDENCE = """concat_ws('|', CASE WHEN s1 THEN 'Worked at a company also on your profile (' || shared || ' overlap).' END, CASE WHEN s2 THEN 'Attended a school also on your profile.' END,
  CASE WHEN s3 THEN 'Both classified as ' || industry_label || ' (' || industry_trust || ').' END, CASE WHEN s4 THEN 'Both located in ' || country || '.' END,
  CASE WHEN s5 THEN 'Connected On is ' || strftime(connected_at, '%Y-%m-%d') || '.' END, CASE WHEN s6 THEN employers || ' distinct employers in employment history.' END,
  CASE WHEN s7 THEN complete || ' of 4 core fields present (URL, company, title, connection date).' END)"""
SIGNS = "concat_ws('|', " + ", ".join(f"CASE WHEN s{i} THEN '{k}:{v[1]}' END" for i, (k, v) in enumerate(fv.CONTEXT_SIGNALS.items(), 1)) + ")"


@query("context_score", SELF + f" SELECT ws, person_id, score, {SIGNS} AS signals, {EVIDENCE} AS evidence FROM scored")
def _score(tables):
    rows = sc.with_context(facts_of(tables), NOW)
    text = lambda make: F.array_join(F.transform("contributions", make), "|")
    return rows.select("ws", "person_id", "score", text(lambda c: F.concat(c["key"], F.lit(":"), c["points"].cast("string"))).alias("signals"),
                       text(lambda c: c["evidence"]).alias("evidence"))


RANKED = "row_number() OVER (PARTITION BY ws ORDER BY score DESC, name, person_id)::INT AS position"
QUIET = f"{YEARS} >= 2 AND (last_interaction_at IS NULL OR (epoch_us({b.NOW}) - epoch_us(last_interaction_at)) / 86400e6 > 365)"


@query("opportunities", SELF + f""" SELECT ws, {RANKED}, person_id, name, current_company, current_title, score AS context_score,
  concat_ws('|', 'Works at ' || current_company, 'Previously worked at a matching company', 'Title contains “Engineer”', 'More than one employer on record') AS reasons FROM scored x
  WHERE contains(current_company_key, 'o') AND person_id IN (SELECT person_id FROM employment WHERE NOT is_current AND contains(company_key, 'stripe'))
    AND contains(lower(current_title), 'engineer') AND employers >= 2 QUALIFY position <= 50""")
def _opportunities(tables):
    wanted = sc.OpportunityQuery(company="o", past_company="Stripe", role="Engineer", recently_moved=True)
    return sc.find_opportunities(facts_of(tables), NOW, wanted).withColumn("reasons", F.array_join("reasons", "|"))


@query("opportunities_by_industry", SELF + f""" SELECT ws, {RANKED}, person_id, name, current_company, current_title, score AS context_score,
  concat_ws('|', 'Classified industry: ' || industry_label || ' (' || industry_confidence || ' confidence)', 'Location contains “NATION”') AS reasons FROM scored x
  WHERE industry_key = 'healthcare' AND contains(lower(location), 'nation') QUALIFY position <= 50""")
def _opportunities_industry(tables):
    wanted = sc.OpportunityQuery(industry="Healthcare", location="NATION")
    return sc.find_opportunities(facts_of(tables), NOW, wanted).withColumn("reasons", F.array_join("reasons", "|"))


@query("reconnection_candidates", SELF + f""" SELECT ws, {RANKED}, person_id, name, current_company, current_title, score AS context_score,
  'Connected over 2 years ago with no recorded contact in the last year' AS reasons FROM scored WHERE {QUIET} QUALIFY position <= 25""")
def _reconnect(tables):
    return sc.reconnection_candidates(facts_of(tables), NOW).withColumn("reasons", F.array_join("reasons", "|"))


SEGMENT_RULES = [
    ('{"company":"o","pastCompany":"Stripe","role":"Engineer","recentlyMoved":true}',
     "contains(current_company_key, 'o') AND person_id IN (SELECT person_id FROM employment WHERE NOT is_current AND contains(company_key, 'stripe')) AND contains(lower(current_title), 'engineer') AND employers >= 2"),
    ('{"industry":" HealthCare","location":"NATION"}', "industry_key = 'healthcare' AND contains(lower(location), 'nation')"),
    ('{"olderQuiet":true}', QUIET),
    ('{"role":"manager","company":null}', "contains(lower(current_title), 'manager')"),
    ('{"company":"","olderQuiet":false}', "false"),
]


@query("segments_members", SELF + """, saved AS (SELECT r_name AS ws, lower(n_name) AS segment_key, n_nationkey % 5 AS rule FROM nation JOIN region ON r_regionkey = n_regionkey)
  SELECT ws, segment_key, person_id, score AS context_score FROM scored x JOIN saved USING (ws) WHERE CASE rule """
       + " ".join(f"WHEN {i} THEN {where}" for i, (_, where) in enumerate(SEGMENT_RULES)) + " END")
def _segment_members(tables):
    nations = tables.table("nation").join(tables.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rule = F.element_at(F.array(*[F.lit(q) for q, _ in SEGMENT_RULES]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    saved = nations.select(F.col("r_name").alias("ws"), F.lower("n_name").alias("segment_key"), rule.alias("query"))
    return sm.members(saved, facts_of(tables), NOW)


# --- graph -------------------------------------------------------------------------------------------

HUBS = """, hub AS (SELECT * FROM company_counts WHERE connection_count >= 1 QUALIFY row_number() OVER (PARTITION BY ws ORDER BY connection_count DESC, name, company_id) <= {n}),
tail AS (SELECT ws, count(*) AS hidden, sum(connection_count)::BIGINT AS ppl FROM company_counts c ANTI JOIN hub USING (company_id) WHERE connection_count >= 1 GROUP BY ws),
school AS (""" + top_sql("s", SCHOOLS, 12) + """),
moved AS (SELECT a.ws, a.company_id AS from_id, b.company_id AS to_id, count(DISTINCT a.person_id) AS weight FROM employment_all a JOIN employment_all b
  ON b.person_id = a.person_id AND b.company_id <> a.company_id AND b.is_current AND NOT a.is_current SEMI JOIN hub h ON h.company_id = a.company_id
  WHERE b.company_id IN (SELECT company_id FROM hub) GROUP BY 1, 2, 3)"""


def graph_of(tables):
    return gr.overview(tables.people, counted_of(tables), tables.employment, facts_of(tables).education)


@query("graph_nodes", HUBS.format(n=40) + """ SELECT ws, 'self' AS node_id, 'self' AS type, name AS label, 1::BIGINT AS size, person_id::VARCHAR AS entity_id, NULL::BIGINT AS current, NULL::BIGINT AS former FROM people_all WHERE is_self
  UNION ALL SELECT ws, 'company:' || company_id, 'company', name, connection_count, company_id, current_count, former_count FROM hub
  UNION ALL SELECT ws, 'cluster:companies', 'cluster', hidden || ' smaller companies', ppl, NULL, NULL, NULL FROM tail
  UNION ALL SELECT ws, 'school:' || value, 'school', value, count, NULL, NULL, NULL FROM school""")
def _nodes(tables):
    return graph_of(tables).nodes


@query("graph_edges", HUBS.format(n=40) + """ SELECT ws, 'self' AS source, 'company:' || company_id AS target, 'works_at' AS type, current_count AS weight FROM hub WHERE current_count > 0
  UNION ALL SELECT ws, 'self', 'company:' || company_id, 'worked_at', former_count FROM hub WHERE former_count > 0
  UNION ALL SELECT ws, 'self', 'cluster:companies', 'in_cluster', ppl FROM tail
  UNION ALL SELECT ws, 'company:' || from_id, 'company:' || to_id, 'moved_to', weight FROM moved
  UNION ALL SELECT ws, 'self', 'school:' || value, 'studied_at', count FROM school""")
def _edges(tables):
    return graph_of(tables).edges


@query("graph_tail", HUBS.format(n=6) + " SELECT ws, hidden, ppl AS people FROM tail")
def _tail(tables):
    counted = counted_of(tables)
    return gr.hidden_companies(counted, gr.hubs(counted, limit=6))


@query("graph_moved_to", HUBS.format(n=5) + " SELECT * FROM moved")
def _moved(tables):
    return gr.moved_to(tables.employment, gr.hubs(counted_of(tables), limit=5))


@query("graph_company", """, stay AS (SELECT e.ws, company_id, e.person_id, p.name, bool_or(e.is_current) AS is_current FROM employment_all e JOIN people p USING (ws, person_id)
    WHERE e.company_id IS NOT NULL GROUP BY 1, 2, 3, 4),
  drawn AS (SELECT * FROM stay QUALIFY row_number() OVER (PARTITION BY ws, company_id ORDER BY person_id) <= 30)
  SELECT ws, company_id, 'self' AS source, 'company:' || company_id AS target, 'works_at' AS type, connection_count AS weight,
    greatest(connection_count - (SELECT count(*) FROM drawn d WHERE d.company_id = c.company_id), 0) AS hidden_people FROM company_counts c
  UNION ALL SELECT d.ws, d.company_id, 'person:' || person_id, 'company:' || d.company_id, CASE WHEN is_current THEN 'works_at' ELSE 'worked_at' END, 1,
    greatest(connection_count - (SELECT count(*) FROM drawn x WHERE x.company_id = d.company_id), 0) FROM drawn d JOIN company_counts c USING (company_id)""")
def _company_graph(tables):
    graph, hidden = gr.company_graphs(tables.people, counted_of(tables), tables.employment, limit=30)
    return graph.edges.join(hidden, ["ws", "company_id"])


# --- search --------------------------------------------------------------------------------------------

Q = "golman saks"
PEOPLE_HITS = f"""SELECT ws, 'person' AS type, 0 AS t, row_number() OVER (PARTITION BY ws ORDER BY score DESC, name, person_id) AS w, person_id::VARCHAR AS id, name AS title,
    nullif(concat_ws(' at ', current_title, current_company), '') AS subtitle, location AS detail, score FROM (
    SELECT *, round(greatest({TOKEN_RANK('{q}')}, {SIMILAR('name', "'{q}'")}, CASE WHEN current_company ILIKE '%{{q}}%' THEN 0.35 ELSE 0 END::DOUBLE, CASE WHEN email = lower('{{q}}') THEN 1 ELSE 0 END::DOUBLE), 9) AS score
    FROM people WHERE {HAS_ALL('{q}')} OR name ILIKE '%{{q}}%' OR current_company ILIKE '%{{q}}%' OR current_title ILIKE '%{{q}}%' OR location ILIKE '%{{q}}%' OR email = lower('{{q}}')
      OR {SIMILAR('name', "'{q}'")} > 0.3 OR {SIMILAR("coalesce(current_company, '')", "'{q}'")} > 0.3) QUALIFY w <= 20"""


def search_sql(q):
    fill = lambda s: s.replace("{{q}}", q).replace("{q}", q)
    return f"""{fill(PEOPLE_HITS)}
  UNION ALL SELECT ws, 'company', 1, row_number() OVER (PARTITION BY ws ORDER BY score DESC, connection_count DESC, company_id) AS w, company_id, name, industry,
    connection_count || ' connection' || CASE WHEN connection_count = 1 THEN '' ELSE 's' END, score FROM (
    SELECT *, round(greatest({SIMILAR('name', b.lit(q))}, CASE WHEN name ILIKE '%{q}%' THEN 0.5 ELSE 0 END::DOUBLE), 9) AS score FROM company_counts WHERE name ILIKE '%{q}%' OR {SIMILAR('name', b.lit(q))} > 0.3) QUALIFY w <= 20
  UNION ALL SELECT ws, 'conversation', 2, row_number() OVER (PARTITION BY ws ORDER BY conversation_id) AS w, conversation_id::VARCHAR, coalesce(name, title, 'Conversation'),
    n || ' message' || CASE WHEN n = 1 THEN '' ELSE 's' END, strftime(last_at, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_ms(last_at) % 1000)::VARCHAR, 3, '0') || 'Z', 0.2::DOUBLE FROM (
    SELECT c.ws, c.conversation_id, p.name, c.title, count(*) AS n, max(sent_at) AS last_at, bool_or(content ILIKE '%{q}%') AS said FROM convs c JOIN messages m USING (conversation_id)
    LEFT JOIN people_all p ON p.person_id = c.person_id GROUP BY 1, 2, 3, 4) WHERE said OR coalesce(title ILIKE '%{q}%', false) OR coalesce(name ILIKE '%{q}%', false) QUALIFY w <= 20"""


def search_query(name, q):
    @query(name, f""" SELECT ws, position, type, id, title, subtitle, detail, score, total FROM (SELECT *, count(*) OVER (PARTITION BY ws) AS total,
      row_number() OVER (PARTITION BY ws ORDER BY score DESC, t, w)::INT AS position FROM ({search_sql(q)})) WHERE position <= 20""")
    def _search(tables):
        f = facts_of(tables)
        return se.global_search(f.people, counted_of(tables), tables.conversations, tables.messages, tables.people, q)


search_query("global_search", "golman saks")
search_query("global_search_text", "thread 1")


TERMS = ["golman saks", "thread 1", "engineer", "c12@example.com", "stri", "PAY", "no", "the 2", "t_read 1%", "deloitte engineer", "zzz nowhere"]


@query("search_terms", """ SELECT ws, q, position, type, id, title, subtitle, detail, score, total FROM (SELECT *, count(*) OVER (PARTITION BY q, ws) AS total,
      row_number() OVER (PARTITION BY q, ws ORDER BY score DESC, t, w)::INT AS position FROM (""" + " UNION ALL ".join(
    f"SELECT {b.lit(q)} AS q, * FROM ({search_sql(q)})" for q in TERMS) + ")) WHERE position <= 20")
def _search_terms(tables):
    f = facts_of(tables)
    return po.search(tables.postings, tables.posting_counts, f.people, counted_of(tables), tables.talks, tables.messages, tables.people, TERMS)


# --- keyset pages of the other lists -----------------------------------------------------------------

LISTS = {
    "company": ("company_id", "connection_count DESC, name, company_id", "company_counts"),
    "conversation": ("conversation_id", "last_message_at DESC NULLS LAST, conversation_id",
                     "(SELECT c.ws, c.conversation_id, max(sent_at) AS last_message_at FROM convs c LEFT JOIN messages m USING (conversation_id) GROUP BY 1, 2)"),
    "job": ("job_id", "coalesce(applied_at, saved_at) DESC NULLS LAST, title, job_id", "jobs"),
}


@query("list_pages_after", " " + " UNION ALL ".join(
    f"SELECT ws, '{kind}' AS kind, {id_}::VARCHAR AS id, (row_number() OVER (PARTITION BY ws ORDER BY {o}) - 5)::INT AS position FROM {source} QUALIFY position BETWEEN 1 AND 5"
    for kind, (id_, o, source) in LISTS.items()))
def _list_pages(tables):
    key = lambda id_: (id_, False, True)
    lists = {
        "company": (counted_of(tables), [*pg.COMPANIES["connections"], key("company_id")]),
        "conversation": (tables.talks, [*pg.CONVERSATIONS, key("conversation_id")]),
        "job": (tables.jobs.withColumn("used_at", F.coalesce("applied_at", "saved_at")), [*pg.JOBS, key("job_id")]),
    }
    out = None
    for kind, (rows, order) in lists.items():
        page = pg.after(rows, order, pg.starts(rows, order, 5).filter("page = 2"), 5)
        page = page.select("ws", F.lit(kind).alias("kind"), F.col(LISTS[kind][0]).cast("string").alias("id"), "position")
        out = page if out is None else out.unionByName(page)
    return out
