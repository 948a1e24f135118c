"""Queries over insights, questions and the assembled report."""

from functools import reduce

from pyspark.sql import functions as F

from tieline.checks import base_sql as b
from tieline.checks.careers import GROWTH, MOVES, PAIR
from tieline.checks.composition import BAND, CTE, EXPLAIN, IND, SPREAD_SQL, TXT, concentration_sql
from tieline.checks.registry import query
from tieline.functions import fixed_values as fv
from tieline.operators.questions import NetworkAnalyst, with_intent
from tieline.plans.report import LIMITATIONS, AnalyticsReport
from tieline.sources.binding import NOW
from tieline.sources.facts import facts_of


def report_of(tables):
    return AnalyticsReport(facts_of(tables), NOW)


SPREAD = SPREAD_SQL.replace(SPREAD_SQL[SPREAD_SQL.index("("):SPREAD_SQL.index("),\nmeasured")],
                            "(" + concentration_sql("d_company", "company"))
COUNTS = """, movers AS (SELECT ws, person_id FROM employment JOIN people USING (ws, person_id) WHERE employment.company_key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT employment.company_key) > 1),
mover_n AS (SELECT ws, count(*) AS people FROM movers GROUP BY ws), move_n AS (SELECT ws, count(*) AS moves FROM moves GROUP BY ws),
new_n AS (SELECT ws, count(*) AS n FROM people JOIN pair USING (ws) WHERE first_import_id = current_import GROUP BY ws),
gone_n AS (SELECT ws, count(*) AS n FROM people JOIN pair USING (ws) WHERE previous_import IS NOT NULL AND last_import_id <> current_import GROUP BY ws)""".replace(
    "FROM employment JOIN people USING (ws, person_id)", "FROM employment SEMI JOIN people USING (ws, person_id)")
TOP = lambda d, k: f"(SELECT * FROM {d} WHERE known >= {k} QUALIFY row_number() OVER (PARTITION BY ws ORDER BY count DESC, label) = 1)"


@query("insights", CTE["company"] + CTE["industry"] + SPREAD + GROWTH + MOVES + PAIR + COUNTS + f""",
med AS (SELECT ws, list_sort(list(share_of_known)) AS s FROM d_industry GROUP BY ws)
SELECT ws, 'top-company' AS id, count || ' connections associated with ' || label AS title,
  {TXT('share_of_network')} || '% of the network currently lists ' || label || ' as employer (' || count || ' of ' || total || ').' AS description,
  count || ' people with current employer ' || label || '.' AS evidence, count AS numerator, total AS denominator, share_of_network AS percent, 'high' AS confidence,
  count AS affected_count, 'company' AS drill_metric, key AS drill_value FROM {TOP('d_company', 10)}
UNION ALL SELECT ws, 'company-concentration', CASE {BAND} WHEN 'low' THEN 'Company representation is concentrated' WHEN 'high' THEN 'Company representation is spread out' ELSE 'Company representation is moderately concentrated' END,
  {EXPLAIN}, 'HHI ' || printf('%.3f', hhi) || ' on classified employers; coverage ' || {TXT(b.pct('known', 'total'))} || '%.', top_count, known, top_share, 'high', known, 'company', NULL FROM measured WHERE known >= 20
UNION ALL SELECT ws, 'top-industry', label || ' is the largest classified industry', count || ' of ' || known || ' classified connections (' || {TXT('share_of_known')} || '%). ' || (total - known) || ' could not be classified.',
  method, count, known, share_of_known, confidence, count, 'industry', key FROM {TOP('d_industry', 15)}
UNION ALL SELECT ws, 'gap-industry-' || key, label || ' is relatively small in this network', count || ' of ' || known || ' classified connections (' || {TXT('share_of_known')} ||
  '%). This is below half the median category share. That is a description of the data, not a recommendation to add connections.', count || ' classified as ' || label || '.', count, known, share_of_known, confidence, count, 'industry', key
  FROM (SELECT * FROM d_industry JOIN med USING (ws) WHERE known >= 20 AND len(s) >= 3 AND share_of_known < s[len(s) // 2 + 1] / 2 QUALIFY row_number() OVER (PARTITION BY ws ORDER BY count DESC, label) <= 3)
UNION ALL SELECT ws, 'growth-window', last_90_days || ' connections added in the last 90 days', last_90_days || ' of ' || known || ' dated connections fall in the last 90 days. Growth is ' || acceleration ||
  '. Earliest Connected On in the file: ' || strftime(earliest, '%Y-%m-%d') || '.', 'Dated connections: ' || known || ' of ' || total || ' (' || {TXT('coverage_percent')} || '% coverage).', last_90_days, known,
  {b.pct('last_90_days', 'known')}, 'high', last_90_days, 'recent', NULL FROM growth WHERE known >= 10
UNION ALL SELECT ws, 'career-moves', people || ' ' || CASE WHEN people = 1 THEN 'person has' ELSE 'people have' END || ' more than one employer on record', moves || {b.lit(fv.INSIGHTS['career-moves']['description'][len('{moves}'):])},
  moves || ' transitions across ' || people || ' people.', people, total, {b.pct('people', 'total')}, 'high', people, 'changed_company', NULL FROM mover_n JOIN move_n USING (ws) JOIN sizes USING (ws)
UNION ALL SELECT ws, 'new-since-import', n.n || ' connections first appeared in the latest Connections.csv import', 'Compared with the previous connections import. ' || coalesce(g.n, 0) || ' people from earlier imports were not in the latest Connections.csv.',
  'first_import_id = ' || current_import || '.', n.n, total, {b.pct('n.n', 'total')}, 'high', n.n, 'new_since_import', NULL FROM pair JOIN new_n n USING (ws) LEFT JOIN gone_n g USING (ws) JOIN sizes USING (ws) WHERE previous_import IS NOT NULL
UNION ALL SELECT ws, 'location-coverage', 'Location is almost never present for connections', NULL, NULL, count(location), count(*), {b.pct('count(location)', 'count(*)')}, 'high', count(*) - count(location), 'quality', 'location'
  FROM people GROUP BY ws HAVING {b.pct('count(location)', 'count(*)')} < 5""")
def _insights(tables):
    return report_of(tables).insights.select("ws", "id", "title", "description", "evidence", "numerator", "denominator", "percent",
                                             "confidence", "affected_count", "drill_metric", "drill_value")


TEMPLATES = [
    ("Who in my network works at ", "?"), ("How many people work at ", " today"), ("Which people previously worked at ", ""), ("connections at the ", "?"),
    ("What changed since my last import? ", ""), ("What are the network gaps around ", ""), ("Who recently moved to ", ""), ("Which companies hire from ", "?"),
    ("Where are people based in ", ""), ("Which city is home to people from ", "?"), ("Who knows healthcare at ", ""), ("Show the path from Acme to ", "?"),
    ("Tell me about ", ""), ("formerly works ", " and who does AI?"),
]
QTEXT = f"{b.array([a for a, _ in TEMPLATES])}[(employment_id % {len(TEMPLATES)} + 1)::INT] || coalesce(company_name, '') || {b.array([z for _, z in TEMPLATES])}[(employment_id % {len(TEMPLATES)} + 1)::INT]"
HAS = lambda p: f"regexp_matches(q, {b.lit(p)})"
PART = lambda p, i=1: f"trim(regexp_extract(q, {b.lit(p)}, {i}))"


@query("question_intents", f""", asked AS (SELECT employment_id, {QTEXT} AS question, lower(trim({QTEXT})) AS q FROM employment_all),
  judged AS (SELECT *, CASE WHEN q = '' THEN 'unsupported' {' '.join(f"WHEN {HAS(p)} THEN '{n}'" for n, p in fv.QUESTION_KEYWORDS)}
    WHEN {HAS(fv.FORMER_COMPANY_QUESTION)} THEN 'people_former_company' WHEN {HAS(fv.CURRENT_COMPANY_QUESTION)} THEN 'people_at_company'
    WHEN {HAS(fv.LOCATION_WORDS)} AND {HAS(fv.LOCATION_QUESTION)} THEN 'people_in_location' WHEN {HAS(fv.INDUSTRY_QUESTION)} THEN 'industry_count'
    WHEN {HAS(fv.PATH_QUESTION)} THEN 'career_path' ELSE 'unsupported' END AS intent FROM asked)
  SELECT employment_id, question, intent, CASE intent WHEN 'people_former_company' THEN {PART(fv.FORMER_COMPANY_QUESTION)}
    WHEN 'people_at_company' THEN trim(regexp_replace(regexp_extract(q, {b.lit(fv.CURRENT_COMPANY_QUESTION)}, 1), '^the\\s+', '')) WHEN 'people_in_location' THEN {PART(fv.LOCATION_QUESTION)}
    WHEN 'industry_count' THEN {PART(fv.INDUSTRY_QUESTION)} WHEN 'career_path' THEN {PART(fv.PATH_QUESTION)} END AS subject,
    CASE intent WHEN 'career_path' THEN {PART(fv.PATH_QUESTION, 2)} END AS target FROM judged""")
def _intents(tables):
    from tieline.sources.binding import pick

    no = F.col("employment_id") % len(TEMPLATES)
    question = F.concat(pick([a for a, _ in TEMPLATES], no), F.coalesce("company_name", F.lit("")), pick([z for _, z in TEMPLATES], no))
    return with_intent(tables.employment.select("employment_id", question.alias("question")), F.col("question"))


QUESTIONS = {
    "network_size": "How large is my network?", "people_at_company": "Who in my network works at OpenAI?",
    "people_former_company": "Who previously worked at Acme", "recent_movers": "Who changed jobs?", "top_companies": "top companies",
    "industry_count": "who is in consulting", "underrepresented": "network gaps", "what_changed": "What changed since my last import?",
    "people_in_location": "where are people based in UK", "career_path": "from acme to globex", "unsupported": "Tell me who my best friends are",
}
S = lambda n: f"CASE WHEN {n} = 1 THEN '' ELSE 's' END"


def matched(intent, where, tail, confidence="'high'", source="people p"):
    return f"""SELECT ws, '{intent}' AS intent, coalesce(n, 0) || {tail} AS answer, {confidence} AS confidence FROM sizes LEFT JOIN (SELECT p.ws, count(*) AS n FROM {source} WHERE {where} GROUP BY 1) USING (ws)"""


ANSWERS = " UNION ALL ".join([
    "SELECT ws, 'network_size' AS intent, total || ' connections in the imported network (excluding you).' AS answer, 'high' AS confidence FROM sizes",
    matched("people_at_company", "contains(coalesce(current_company_key, ''), 'openai') OR contains(lower(coalesce(current_company, '')), 'openai')",
            f"' connection' || {S('coalesce(n, 0)')} || ' currently list an employer matching “openai”.'"),
    matched("people_former_company", "person_id IN (SELECT person_id FROM employment WHERE NOT is_current AND contains(company_key, 'acme'))",
            f"' connection' || {S('coalesce(n, 0)')} || ' have a former employment row matching “acme”.'"),
    "SELECT ws, 'recent_movers', people || CASE WHEN people = 1 THEN ' person has' ELSE ' people have' END || ' more than one employer on record (' || moves || ' transitions).', 'high' FROM mover_n JOIN move_n USING (ws)",
    f"""SELECT ws, 'top_companies', string_agg(label || ': ' || count || ' (' || {TXT('share_of_network')} || '% of network)', '; ' ORDER BY r) || '. ' || (any_value(total) - any_value(known)) || ' have no current employer.', 'high'
      FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY count DESC, label) AS r FROM d_company) WHERE r <= 8 GROUP BY ws""",
    f"""SELECT ws, 'industry_count', count || ' of ' || known || ' classified connections (' || {TXT('share_of_known')} || '%) match ' || label || '. ' || (total - known) || ' unclassified.', confidence
      FROM (SELECT * FROM d_industry WHERE key = 'consulting' OR contains(lower(label), 'consulting') QUALIFY row_number() OVER (PARTITION BY ws ORDER BY count DESC, label) = 1)""",
    """SELECT ws, 'industry_count', 'No classified connections match “consulting”. ' || (total - known) || ' unclassified of ' || total || '.', 'low'
      FROM (SELECT ws, max(known) AS known, max(total) AS total FROM d_industry GROUP BY ws HAVING NOT bool_or(key = 'consulting' OR contains(lower(label), 'consulting')))""",
    f"""SELECT ws, 'underrepresented', CASE WHEN any_value(known) < 20 THEN 'Only ' || any_value(known) || ' connections could be classified, which is too few for a gap comparison.'
      ELSE 'Smaller classified industries: ' || string_agg(label || ' ' || {TXT('share_of_known')} || '%', ', ' ORDER BY r DESC) || '. This is not a recommendation to add connections.' END, 'medium'
      FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY count ASC, label DESC) AS r FROM d_industry WHERE share_of_known > 0) WHERE r <= 5 GROUP BY ws""",
    """SELECT ws, 'what_changed', coalesce(n.n, 0) || ' first seen in the latest Connections.csv import; ' || coalesce(g.n, 0) || ' not seen in that import; ' || moves || ' company transitions on record.', 'high'
      FROM pair LEFT JOIN new_n n USING (ws) LEFT JOIN gone_n g USING (ws) JOIN move_n USING (ws)""",
    matched("people_in_location", "contains(lower(location), 'uk')", f"' connection' || {S('coalesce(n, 0)')} || ' have a location containing “uk”. ' || (SELECT count(*) FROM people p WHERE p.ws = sizes.ws AND location IS NULL) || ' have no location.'",
            "CASE WHEN coalesce(n, 0) > 0 THEN 'high' ELSE 'low' END"),
    matched("career_path", "contains(from_key, 'acme') AND contains(to_key, 'globex')", f"' recorded transition' || {S('coalesce(n, 0)')} || ' from an employer matching “acme” to one matching “globex”.'", source="moves p"),
    f"SELECT ws, 'unsupported', {b.lit(fv.ANSWER_TEXT['unsupported'])}, 'low' FROM sizes",
])


@query("question_answers", CTE["company"] + CTE["industry"] + MOVES + PAIR + COUNTS + f" SELECT ws, intent, answer, confidence FROM ({ANSWERS})")
def _answers(tables):
    return NetworkAnalyst(report_of(tables)).answers(list(QUESTIONS.values())).drop("question")


def listed(intent, where, detail="nullif(concat_ws(' at ', current_title, current_company), '')", limit=50):
    return f"""SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY person_id)::INT AS position, person_id::VARCHAR AS person_id, name, {detail} AS detail, '{intent}' AS intent
    FROM people p WHERE {where} QUALIFY position <= {limit}"""


def listed_moves(intent, where):
    return f"""SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY person_id, employment_id)::INT, person_id::VARCHAR, name, from_company || ' → ' || to_company, '{intent}'
    FROM moves WHERE {where} QUALIFY row_number() OVER (PARTITION BY ws ORDER BY person_id, employment_id) <= 50"""


RECORDS = {
    "people_at_company": listed("people_at_company", "contains(coalesce(current_company_key, ''), 'openai') OR contains(lower(coalesce(current_company, '')), 'openai')"),
    "people_former_company": listed("people_former_company", "person_id IN (SELECT person_id FROM employment WHERE NOT is_current AND contains(company_key, 'acme'))", "current_company"),
    "recent_movers": listed_moves("recent_movers", "true"),
    "career_path": listed_moves("career_path", "contains(from_key, 'acme') AND contains(to_key, 'globex')"),
    "top_companies": "SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY count DESC, label)::INT AS position, NULL, label, count || ' people', 'top_companies' FROM d_company QUALIFY position <= 8",
    "underrepresented": """SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY r DESC)::INT, NULL, label, count || ' people', 'underrepresented' FROM (
    SELECT *, row_number() OVER (PARTITION BY ws ORDER BY count ASC, label DESC) AS r FROM d_industry WHERE share_of_known > 0) WHERE r <= 5""",
    "industry_count": listed("industry_count", f"({b.industry_key('p.industry', 'p.current_title', 'p.current_company')}) IN (SELECT key FROM d_industry WHERE key = 'consulting' OR contains(lower(label), 'consulting'))"),
    "what_changed": listed("what_changed", "first_import_id IN (SELECT current_import FROM pair)", "'New in latest connections import'", 30),
    "people_in_location": listed("people_in_location", "contains(lower(location), 'uk')", "location"),
}


@query("question_records", CTE["company"] + CTE["industry"] + MOVES + PAIR + " " + " UNION ALL ".join(RECORDS.values()))
def _records(tables):
    """The records of every intent that has any."""
    analyst = NetworkAnalyst(report_of(tables))
    parts = [analyst.records(QUESTIONS[i]).withColumn("intent", F.lit(i)) for i in RECORDS]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("analytics_report", "".join(CTE[d] for d in ("company", "industry", "country", "role_family")) + SPREAD_SQL + GROWTH + MOVES + PAIR + COUNTS + f""",
  bands AS (SELECT ws, max({BAND}) FILTER (dimension = 'company') AS companies, max({BAND}) FILTER (dimension = 'industry') AS industries,
    max({BAND}) FILTER (dimension = 'country') AS geography, max({BAND}) FILTER (dimension = 'role_family') AS roles FROM measured GROUP BY ws)
  SELECT ws, g.total AS network_size, last_90_days, acceleration, companies, industries, geography, roles, coalesce(moves, 0) AS moves, coalesce(people, 0) AS people_with_multiple_employers,
    coalesce(n.n, 0) AS new_connections, coalesce(gn.n, 0) AS not_seen FROM growth g LEFT JOIN bands USING (ws) LEFT JOIN move_n USING (ws) LEFT JOIN mover_n USING (ws) LEFT JOIN new_n n USING (ws) LEFT JOIN gone_n gn USING (ws)""")
def _report(tables):
    return report_of(tables).summary


@query("report_limitations", f" SELECT ws, i::INT AS position, {b.array(LIMITATIONS)}[i + 1] AS text FROM (SELECT DISTINCT ws FROM people), range({len(LIMITATIONS)}) r(i)")
def _limitations(tables):
    return report_of(tables).limitations


@query("report_compact", CTE["company"] + MOVES + """ SELECT ws, 'career_moves' AS list, least(count(*), 5) AS shown FROM moves GROUP BY ws
  UNION ALL SELECT ws, 'company_changes', least(count(*), 3) FROM moves WHERE from_key <> to_key GROUP BY ws""")
def _compact(tables):
    out = report_of(tables).compact({"career_moves": 5, "company_changes": 3})
    count = lambda name: out[name].groupBy("ws").agg(F.lit(name).alias("list"), F.count(F.lit(1)).alias("shown"))
    return count("career_moves").unionByName(count("company_changes"))
