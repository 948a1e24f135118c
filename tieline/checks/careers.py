"""Queries over time, mobility and changes between imports."""

from pyspark.sql import functions as F

from tieline.checks import base_sql as b
from tieline.checks.registry import query
from tieline.functions import fixed_values as fv
from tieline.operators import changes, growth, mobility, rollups
from tieline.sources import facts as fa
from tieline.sources.binding import NOW
from tieline.sources.facts import facts_of

MOVES = """, paired AS (SELECT *, lag(struct_pack(k := company_key, n := company_name, t := title)) OVER (PARTITION BY ws, person_id
    ORDER BY started_on NULLS FIRST, observed_at, is_current, employment_id) AS prev FROM employment WHERE company_key IS NOT NULL),
moves AS (SELECT e.ws, e.person_id, p.name, prev.n AS from_company, prev.k AS from_key, e.company_name AS to_company, e.company_key AS to_key,
    prev.t AS from_title, e.title AS to_title, e.observed_at, p.name || ' has employment rows at ' || prev.n || ' then ' || e.company_name || '.' AS evidence, e.employment_id
  FROM paired e JOIN people p ON p.person_id = e.person_id WHERE prev IS NOT NULL AND prev.k <> e.company_key)"""
PAIR = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY uploaded_at DESC, import_id DESC) AS rn FROM imports WHERE had_connections),
pair AS (SELECT ws, max(import_id) FILTER (rn = 1) AS current_import, max(import_id) FILTER (rn = 2) AS previous_import FROM ranked WHERE rn <= 2 GROUP BY ws)"""
MONTHS = """, months AS (SELECT ws, date_trunc('month', connected_at)::DATE AS m, count(*) AS added FROM people WHERE connected_at IS NOT NULL GROUP BY 1, 2),
axis AS (SELECT ws, unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m, sum(added)::BIGINT AS dated FROM months GROUP BY ws),
series AS (SELECT ws, strftime(m, '%Y-%m') AS month, coalesce(added, 0) AS added, dated,
  sum(coalesce(added, 0)) OVER (PARTITION BY ws ORDER BY m)::BIGINT AS cumulative FROM axis LEFT JOIN months USING (ws, m))"""
AGE = f"((epoch_us({b.NOW}) - epoch_us(connected_at)) / 86400e6)"


def moves_of(tables):
    f = facts_of(tables)
    return mobility.career_moves(f.people, f.employment)


@query("career_moves", MOVES + " SELECT * FROM moves")
def _moves(tables):
    return moves_of(tables)


@query("career_flows", MOVES + """ SELECT ws, from_key, to_key, arg_min(from_company, (person_id, employment_id)) AS from_label,
  arg_min(to_company, (person_id, employment_id)) AS to_label, count(*) AS count, count(DISTINCT person_id) AS people FROM moves GROUP BY 1, 2, 3""")
def _flows(tables):
    return mobility.career_flows(moves_of(tables))


@query("multi_employer", """ SELECT ws, person_id, count(DISTINCT company_key) AS employers FROM employment JOIN people USING (ws, person_id)
  WHERE company_key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT company_key) > 1""".replace("company_key", "employment.company_key"))
def _multi(tables):
    f = facts_of(tables)
    return mobility.multiple_employers(f.people, f.employment)


ROLE_PAIRS = f"SELECT ws, {b.role_key('from_title')} AS from_key, {b.role_key('to_title')} AS to_key FROM moves"


@query("role_transitions", MOVES + f""" SELECT ws, from_key, to_key, {b.label_of('from_key', fv.ROLE_LABELS)} AS from_label,
  {b.label_of('to_key', fv.ROLE_LABELS)} AS to_label, count(*) AS count FROM ({ROLE_PAIRS})
  WHERE from_key IS NOT NULL AND to_key IS NOT NULL AND from_key <> to_key GROUP BY ALL""")
def _roles(tables):
    return mobility.role_transitions(moves_of(tables))


_TO = ("p.industry", "m.to_title", "m.to_company")
_FROM = ("NULL::VARCHAR", "m.from_title", "m.from_company")


@query("industry_transitions", MOVES + f""" SELECT ws, from_key, to_key, min(from_label) AS from_label, min(to_label) AS to_label, count(*) AS count FROM (
  SELECT m.ws, {b.industry_key(*_FROM)} AS from_key, {b.industry_key(*_TO)} AS to_key, {b.industry_label(*_FROM)} AS from_label, {b.industry_label(*_TO)} AS to_label
  FROM moves m JOIN people p USING (person_id)) WHERE from_key IS NOT NULL AND to_key IS NOT NULL AND from_key <> to_key GROUP BY ws, from_key, to_key""")
def _industry_moves(tables):
    f = facts_of(tables)
    return mobility.industry_transitions(f.people, mobility.career_moves(f.people, f.employment))


LATEST = """, ends AS (SELECT ws, person_id, arg_max(company_name, (observed_at, employment_id)) FILTER (is_current) AS to_company,
  max(observed_at) FILTER (is_current) AS observed_at, arg_max(company_name, (observed_at, employment_id)) FILTER (NOT is_current) AS from_company
  FROM employment WHERE company_name IS NOT NULL GROUP BY 1, 2),
latest_moves AS (SELECT e.ws, e.person_id, p.name, from_company, to_company, observed_at FROM ends e JOIN people p USING (person_id) WHERE lower(from_company) <> lower(to_company))"""


@query("career_moves_latest", LATEST + " SELECT * FROM latest_moves")
def _latest(tables):
    f = facts_of(tables)
    return mobility.moved_latest(f.people, f.employment)


@query("growth_series", MONTHS + f" SELECT ws, month, added, cumulative, dated, {b.pct('added', 'dated')} AS share_of_dated FROM series")
def _series(tables):
    return growth.growth_series(facts_of(tables).people)


@query("growth_dashboard", MONTHS + " SELECT ws, strftime(m, '%Y-%m') AS month, added, sum(added) OVER (PARTITION BY ws ORDER BY m)::BIGINT AS cumulative FROM months")
def _observed(tables):
    return growth.growth_observed_months(facts_of(tables).people)


GROWTH = f""", growth0 AS (SELECT ws, count(connected_at) AS known, count(*) AS total, min(connected_at) AS earliest, max(connected_at) AS latest,
  count(*) FILTER ({AGE} <= 90) AS last_90_days, count(*) FILTER ({AGE} > 90 AND {AGE} <= 180) AS previous_90_days FROM people GROUP BY ws),
growth AS (SELECT *, {b.pct('known', 'total')} AS coverage_percent, CASE WHEN last_90_days + previous_90_days < 8 THEN 'unknown'
  WHEN last_90_days > previous_90_days * 1.25 THEN 'accelerating' WHEN last_90_days < previous_90_days * 0.75 THEN 'decelerating' ELSE 'steady' END AS acceleration FROM growth0)"""


@query("growth_summary", GROWTH + " SELECT * FROM growth")
def _growth(tables):
    return growth.growth_summary(facts_of(tables).people, NOW)


@query("growth_outliers", MONTHS + """ SELECT ws, month, added, round((added - mean) / sd, 9) AS z_score FROM series
  JOIN (SELECT ws, count(*) AS months, avg(added) AS mean, coalesce(stddev_samp(added), 0) AS sd FROM series GROUP BY ws) USING (ws)
  WHERE months >= 12 AND sd > 0 AND round((added - mean) / sd, 9) >= 2""")
def _outliers(tables):
    return growth.unusual_months(facts_of(tables).people)


BUCKET = "CASE " + " ".join(f"WHEN {AGE} < {d} THEN '{k}'" for k, _, d in fv.RECENCY_BUCKETS[:-1]) + " ELSE '5y_plus' END"
BUCKET_VALUES = ", ".join(f"('{k}', '{label}')" for k, label, _ in fv.RECENCY_BUCKETS)


@query("recency", f""", known AS (SELECT ws, count(*) AS total, count(connected_at) AS known FROM people GROUP BY ws),
  counted AS (SELECT ws, {BUCKET} AS key, count(*) AS n FROM people WHERE connected_at IS NOT NULL GROUP BY 1, 2)
  SELECT ws, key, label, coalesce(n, 0) AS count, known, total, {b.pct('coalesce(n, 0)', 'known')} AS share_of_known, {b.pct('coalesce(n, 0)', 'total')} AS share_of_network
  FROM known CROSS JOIN (VALUES {BUCKET_VALUES}) v(key, label) LEFT JOIN counted USING (ws, key)""")
def _recency(tables):
    return growth.recency(facts_of(tables).people, NOW)


@query("import_pair", PAIR + """ SELECT *, CASE WHEN previous_import IS NULL THEN 'Only one connections import is on file. New vs previous requires a later export.'
  ELSE 'People not present in the latest Connections.csv are listed as not seen in that import. That is not proof they were removed from LinkedIn.' END AS limitation FROM pair""")
def _pair(tables):
    return changes.import_pair(facts_of(tables).imports)


@query("new_connections", PAIR + " SELECT ws, person_id, name FROM people JOIN pair USING (ws) WHERE first_import_id = current_import")
def _new(tables):
    f = facts_of(tables)
    return changes.new_connections(f.people, f.imports)


@query("not_seen_in_latest", PAIR + " SELECT ws, person_id, name FROM people JOIN pair USING (ws) WHERE previous_import IS NOT NULL AND last_import_id <> current_import")
def _not_seen(tables):
    f = facts_of(tables)
    return changes.not_seen(f.people, f.imports)


@query("company_changes", MOVES + """ SELECT ws, person_id, name, 'company' AS field, from_company AS "from", to_company AS "to" FROM moves""")
def _company_changes(tables):
    return changes.company_changes(moves_of(tables))


@query("title_changes", MOVES + """ SELECT DISTINCT ws, person_id, name, 'title' AS field, from_title AS "from", to_title AS "to" FROM moves
  WHERE lower(trim(from_title)) <> lower(trim(to_title))""")
def _title_changes(tables):
    return changes.title_changes(moves_of(tables))


# --- derived tables ---------------------------------------------------------------------------


@query("company_rollup", " SELECT ws, company_id, company_key, name, industry, connection_count, current_count, former_count FROM company_counts")
def _company_rollup(tables):
    return rollups.company_totals(tables.companies, tables.employment, tables.people)


@query("interaction_rollup", " SELECT c.ws, person_id, interaction_count, last_interaction_at FROM touch JOIN cust c USING (person_id)")
def _touch(tables):
    return rollups.interaction_totals(tables.conversations, tables.messages, tables.interactions)


@query("conversation_rollup", " SELECT ws, conversation_id, count(*) AS message_count, max(sent_at) AS last_message_at, min(sent_at) AS started_at FROM messages GROUP BY 1, 2")
def _conversations(tables):
    return rollups.conversation_totals(tables.messages)


@query("link_employment", """ SELECT e.ws, e.employment_id, e.company_key, CASE WHEN e.employment_id % 2 = 0 THEN e.company_id ELSE c.company_id END AS company_id
  FROM employment_all e LEFT JOIN companies c USING (ws, company_key)""")
def _link(tables):
    half = tables.employment.withColumn("company_id", F.when(F.col("employment_id") % 2 == 0, F.col("company_id")))
    return rollups.link_employment(half, tables.companies).select("ws", "employment_id", "company_key", "company_id")


@query("retire_snapshots", """, snap AS (SELECT *, CASE WHEN employment_id % 5 = 0 THEN '2001' END AS start_date FROM employment_all)
  SELECT ws, employment_id, NOT (start_date IS NULL AND observed_at < max(observed_at) FILTER (start_date IS NULL) OVER (PARTITION BY ws, person_id)) AS is_current FROM snap""")
def _retire(tables):
    snapshots = tables.employment.withColumn("is_current", F.lit(True)).withColumn(
        "start_date", F.when(F.col("employment_id") % 5 == 0, "2001")
    ).withColumn("end_date", F.lit(None).cast("string"))
    return rollups.retire_snapshots(snapshots).select("ws", "employment_id", "is_current")


@query("owner_current_role", " SELECT ws, person_id, company_name AS current_company, title AS current_title FROM employment_all JOIN owners USING (ws, person_id) WHERE is_current")
def _owner_role(tables):
    return rollups.owner_current_role(tables.employment, tables.people)


@query("derive_stats", """ SELECT ws, count(*) AS people_scored, (SELECT count(company_id) FROM employment_all e WHERE e.ws = p.ws) AS employment_linked,
  (SELECT count(*) FROM companies c WHERE c.ws = p.ws) AS companies_scored,
  (SELECT count(*) FROM (SELECT ws AS w, person_id FROM employment_all WHERE company_key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT company_key) > 1) m WHERE m.w = p.ws) AS career_moves_observed
  FROM people_all p GROUP BY ws""")
def _derive(tables):
    return rollups.derive_stats(tables.people, tables.employment, tables.companies)


@query("skill_totals", """ SELECT ws, o.person_id, lower(skill) AS skill_key, arg_min(skill, (order_id, l_linenumber, l_partkey)) AS skill, count(*) AS endorsements
  FROM (SELECT l_orderkey AS order_id, l_linenumber, l_partkey,
    CASE WHEN l_orderkey % 2 = 0 THEN upper(left(p_type, 1)) || lower(substr(p_type, 2)) ELSE p_type END AS skill FROM lineitem JOIN part ON l_partkey = p_partkey)
  JOIN ords o USING (order_id) JOIN cust USING (person_id) GROUP BY 1, 2, 3""")
def _skills(tables):
    return rollups.skill_totals(tables.endorsements)


@query("self_context", """ SELECT o.ws, o.person_id, coalesce((SELECT string_agg(company_key, '|' ORDER BY company_key) FROM owner_companies c WHERE c.ws = o.ws), '') AS company_keys,
  coalesce((SELECT string_agg(school_key, '|' ORDER BY school_key) FROM owner_schools s WHERE s.ws = o.ws), '') AS schools FROM owners o""")
def _self(tables):
    context = fa.owner_context(tables.people, tables.employment, tables.education)
    return context.select("ws", "person_id", F.array_join("company_keys", "|").alias("company_keys"), F.array_join("schools", "|").alias("schools"))


@query("network_facts", """ SELECT ws, person_id, name, current_company, current_company_key, current_company_id, current_title, location, industry,
  profile_url, email, connected_at, last_interaction_at, interaction_count, first_import_id, last_import_id FROM people""")
def _facts(tables):
    return facts_of(tables).people.select(
        "ws", "person_id", "name", "current_company", "current_company_key", "current_company_id", "current_title", "location",
        "industry", "profile_url", "email", "connected_at", "last_interaction_at", "interaction_count", "first_import_id", "last_import_id")
