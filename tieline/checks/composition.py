"""Queries over distributions, concentration and coverage."""

from functools import reduce

from pyspark.sql import functions as F

from tieline.checks import base_sql as b
from tieline.checks.registry import query
from tieline.functions import fixed_values as fv
from tieline.operators import concentration as con, distributions as dist, quality
from tieline.sources.facts import facts_of

SHOWN = ["ws", "dimension", "key", "label", "count", "known", "total", "share_of_known", "share_of_network",
         "trust", "confidence", "method"]


def bins_cte(dimension: str, inner: str, known: str | None = None) -> str:
    """CTE named d_<dimension> with the bins of rows (ws, person_id, key, label, trust, confidence, method)."""
    known = known or f"SELECT ws, count(*) AS known FROM x_{dimension} GROUP BY ws"
    return f""", x_{dimension} AS ({inner}),
d_{dimension} AS (
  SELECT c.ws, '{dimension}' AS dimension, key, label, c.count, known, total,
    {b.pct('c.count', 'known')} AS share_of_known, {b.pct('c.count', 'total')} AS share_of_network, trust, confidence, method
  FROM (SELECT ws, key, count(*) AS count, arg_min(label, person_id) AS label, arg_min(trust, person_id) AS trust,
          arg_min(confidence, person_id) AS confidence, arg_min(method, person_id) AS method FROM x_{dimension} GROUP BY ws, key) c
  JOIN ({known}) k USING (ws) JOIN sizes USING (ws))"""


KEY_NOW = "coalesce(nullif(current_company_key, ''), lower(trim(coalesce(current_company, ''))))"
IND = ("p.industry", "p.current_title", "p.current_company")
GEO = f"""SELECT ws, person_id, location, parts, len(parts) AS n, {b.country_of('parts[-1]')} AS known_country FROM (
  SELECT ws, person_id, trim(location) AS location, list_filter(list_transform(string_split(location, ','), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM people WHERE trim(location) <> '')"""
GEO_COLUMNS = """CASE WHEN n = 1 AND known_country IS NOT NULL THEN NULL ELSE parts[1] END AS city,
  CASE WHEN n >= 3 OR (n = 2 AND known_country IS NULL) THEN parts[2] END AS region,
  CASE WHEN n >= 3 THEN coalesce(known_country, parts[3]) ELSE known_country END AS country,
  CASE WHEN known_country IS NOT NULL THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS confidence"""


def place_cte(grain: str) -> str:
    return bins_cte(grain, f"""SELECT ws, person_id, lower(trim({grain})) AS key, {grain} AS label, 'derived' AS trust, confidence,
      'Parsed from location “' || location || '” ({grain}).' AS method FROM (SELECT *, {GEO_COLUMNS} FROM ({GEO})) WHERE {grain} <> ''""")


CTE = {
    "company": bins_cte("company", f"""SELECT p.ws, person_id, {KEY_NOW} AS key, coalesce(c.name, current_company) AS label, 'observed' AS trust,
      'high' AS confidence, 'Current employer on the person record, grouped by normalised company key.' AS method
      FROM people p LEFT JOIN companies c ON c.ws = p.ws AND c.company_key = p.current_company_key WHERE {KEY_NOW} <> ''"""),
    "former_company": bins_cte("former_company", f"""SELECT DISTINCT e.ws, e.person_id, e.company_key AS key, c.name AS label, 'derived' AS trust,
      'high' AS confidence, 'Distinct people with a non-current employment row at this company.' AS method
      FROM employment e JOIN companies c USING (ws, company_key) LEFT JOIN people p ON p.person_id = e.person_id
      WHERE NOT e.is_current AND e.company_key IS NOT NULL AND (p.person_id IS NULL OR {KEY_NOW} <> e.company_key)""",
      "SELECT ws, count(DISTINCT person_id) AS known FROM x_former_company GROUP BY ws"),
    "title": bins_cte("title", """SELECT ws, person_id, lower(trim(current_title)) AS key, trim(current_title) AS label, 'observed' AS trust,
      'high' AS confidence, 'Current job title as exported, grouped case-insensitively.' AS method FROM people WHERE trim(current_title) <> ''"""),
    "role_family": bins_cte("role_family", f"""SELECT *, {b.label_of('key', fv.ROLE_LABELS)} AS label, 'inferred' AS trust, 'medium' AS confidence,
      'Job title “' || trim(current_title) || '” matched ' || {b.first_pattern('lower(trim(current_title))', fv.ROLE_RULES)} AS method
      FROM (SELECT ws, person_id, current_title, {b.role_key('current_title')} AS key FROM people) WHERE key IS NOT NULL"""),
    "seniority": bins_cte("seniority", f"""SELECT *, {b.label_of('key', fv.SENIORITY_LABELS)} AS label, 'inferred' AS trust,
      CASE WHEN key IN ('intern', 'c_level', 'founder') THEN 'high' ELSE 'medium' END AS confidence,
      'Job title “' || trim(current_title) || '” matched ' || {b.first_pattern('lower(trim(current_title))', fv.SENIORITY_RULES)} AS method
      FROM (SELECT ws, person_id, current_title, {b.seniority_key('current_title')} AS key FROM people) WHERE key IS NOT NULL"""),
    "industry": bins_cte("industry", f"""SELECT * FROM (SELECT ws, person_id, {b.industry_key(*IND)} AS key, {b.industry_label(*IND)} AS label,
      {b.industry_trust('p.industry')} AS trust, {b.industry_confidence('p.industry')} AS confidence,
      {b.industry_evidence(*IND)} AS method FROM people p) WHERE key IS NOT NULL"""),
    "location": bins_cte("location", """SELECT ws, person_id, lower(trim(location)) AS key, trim(location) AS label, 'observed' AS trust,
      'high' AS confidence, 'Location string as exported.' AS method FROM people WHERE trim(location) <> ''"""),
    "country": place_cte("country"),
    "city": place_cte("city"),
    "school": bins_cte("school", """SELECT ws, person_id, lower(trim(school)) AS key, min(school) AS label, 'observed' AS trust,
      'high' AS confidence, 'Distinct people with an education row at this school.' AS method
      FROM education JOIN people USING (ws, person_id) WHERE trim(school) <> '' GROUP BY 1, 2, 3""",
      "SELECT ws, count(DISTINCT person_id) AS known FROM education JOIN people USING (ws, person_id) WHERE school <> '' GROUP BY ws"),
}

BUILDERS = {
    "company": lambda f: dist.current_companies(f.people, f.companies),
    "former_company": lambda f: dist.former_companies(f.people, f.employment, f.companies),
    "title": lambda f: dist.titles(f.people),
    "role_family": lambda f: dist.role_families(f.people),
    "seniority": lambda f: dist.seniority(f.people),
    "industry": lambda f: dist.industries(f.people),
    "location": lambda f: dist.locations(f.people),
    "country": lambda f: dist.countries(f.people),
    "city": lambda f: dist.cities(f.people),
    "school": lambda f: dist.schools(f.people, f.education),
}
for _name in BUILDERS:
    def _run(tables, _name=_name):
        return BUILDERS[_name](facts_of(tables)).select(*SHOWN)

    query(f"dist_{_name}", CTE[_name] + f" SELECT {', '.join(SHOWN)} FROM d_{_name}")(_run)


def concentration_sql(dimension: str, label: str) -> str:
    return f"""SELECT ws, '{label}' AS dimension, round(sum(p * p), 9) AS hhi, round(greatest(0 - sum(p * ln(p)), 0), 9) AS entropy,
      count(*) AS groups, sum(count) FILTER (rank <= 5)::BIGINT AS top_count, any_value(known) AS known, any_value(total) AS total
      FROM (SELECT *, count * 1.0::DOUBLE / sum(count) OVER (PARTITION BY ws) AS p,
              row_number() OVER (PARTITION BY ws ORDER BY count DESC, key) AS rank FROM {dimension}) GROUP BY ws"""


CONCENTRATED = ["company", "industry", "country", "role_family"]
SPREAD_SQL = f""", spread AS ({' UNION ALL '.join(concentration_sql('d_' + d, d) for d in CONCENTRATED)}),
measured AS (SELECT *, CASE WHEN groups > 1 THEN round(entropy / ln(groups), 9) ELSE 0.0::DOUBLE END AS normalized_entropy,
  {b.pct('top_count', 'known')} AS top_share FROM spread)"""
BAND = "CASE WHEN normalized_entropy >= 0.75 THEN 'high' WHEN normalized_entropy >= 0.45 THEN 'moderate' ELSE 'low' END"
TXT = lambda x: f"regexp_replace(printf('%.1f', {x}), '\\.0$', '')"
EXPLAIN = f"""CASE WHEN hhi >= 0.25 THEN 'The network is concentrated: the top ' || least(5, groups) || ' groups account for ' || {TXT('top_share')} ||
  '% of classified records (HHI ' || {TXT('floor(hhi * 10000 * 10 + 0.5) / 10')} || ' on the 0–10,000 scale).'
  WHEN hhi >= 0.15 THEN 'Moderate concentration. The top ' || least(5, groups) || ' groups account for ' || {TXT('top_share')} || '% of classified records.'
  ELSE 'The classified records are spread across many groups. The top ' || least(5, groups) || ' account for ' || {TXT('top_share')} || '%.' END"""


@query("concentration", "".join(CTE[d] for d in CONCENTRATED) + SPREAD_SQL + f"""
SELECT ws, dimension, hhi, entropy, normalized_entropy, {BAND} AS diversity_band, top_count, top_share, groups, known, total,
  {b.pct('known', 'total')} AS coverage_percent, {EXPLAIN} AS explanation FROM measured""")
def _concentration(tables):
    facts = facts_of(tables)
    bins = reduce(lambda x, y: x.unionByName(y), [BUILDERS[d](facts) for d in CONCENTRATED])
    return con.concentration(bins)


@query("diversity", "".join(CTE[d] for d in CONCENTRATED) + SPREAD_SQL + f"""
SELECT ws, CASE dimension WHEN 'company' THEN 'companies' WHEN 'industry' THEN 'industries' WHEN 'country' THEN 'geography' ELSE 'roles' END AS dimension,
  {BAND} AS diversity_band, hhi, known FROM measured""")
def _diversity(tables):
    facts = facts_of(tables)
    build = lambda d: BUILDERS[d](facts)
    return con.diversity(build("company"), build("industry"), build("country"), build("location"), build("role_family"))


@query("underrepresented", CTE["industry"] + f""", med AS (SELECT ws, list_sort(list(share_of_known)) AS s FROM d_industry GROUP BY ws)
SELECT {', '.join(SHOWN)}, s[len(s) // 2 + 1] AS median_share FROM d_industry JOIN med USING (ws)
WHERE known >= 20 AND len(s) >= 3 AND share_of_known < s[len(s) // 2 + 1] / 2""")
def _underrepresented(tables):
    return dist.underrepresented(BUILDERS["industry"](facts_of(tables))).select(*SHOWN, "median_share")


FIELDS = {"profileUrl": "profile_url", "company": "current_company", "title": "current_title", "location": "location",
          "connectionDate": "connected_at", "email": "email", "observedIndustry": "industry"}
FIELD_SQL = " UNION ALL ".join(
    f"SELECT ws, '{f}' AS field, count({c}) AS known, count(*) - count({c}) AS unknown, count(*) AS total, {b.pct(f'count({c})', 'count(*)')} AS percent FROM people GROUP BY ws"
    for f, c in FIELDS.items())


@query("data_quality", f" SELECT * FROM ({FIELD_SQL})")
def _field_coverage(tables):
    return quality.field_coverage(facts_of(tables).people)


@query("data_quality_summary", """ SELECT ws, total,
  round(CASE WHEN urls > 0 THEN (urls - unique_urls) * 1.0::DOUBLE / urls ELSE 0 END, 9) AS duplicate_url_rate,
  coalesce(many, 0) AS people_with_employment_history, coalesce(schooled, 0) AS people_with_education
  FROM (SELECT ws, count(*) AS total, count(profile_url) AS urls, count(DISTINCT lower(profile_url)) AS unique_urls FROM people GROUP BY ws)
  LEFT JOIN (SELECT ws, count(*) AS many FROM (SELECT ws, person_id FROM employment GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY ws) USING (ws)
  LEFT JOIN (SELECT ws, count(DISTINCT person_id) AS schooled FROM education JOIN people USING (ws, person_id) WHERE school <> '' GROUP BY ws) USING (ws)""")
def _quality_summary(tables):
    f = facts_of(tables)
    return quality.quality_summary(f.people, f.employment, f.education)


@query("data_quality_dashboard", """ SELECT ws, count(*) AS total, count(current_company) AS with_company, count(current_title) AS with_title,
  count(location) AS with_location, count(email) AS with_email, count(connected_at) AS with_connection_date FROM people GROUP BY ws""")
def _quality_dashboard(tables):
    return quality.field_counts(facts_of(tables).people)


@query("classify_industry", f""" SELECT * FROM (SELECT ws, person_id, {b.industry_key(*IND)} AS key, {b.industry_label(*IND)} AS label,
  {b.industry_trust('p.industry')} AS trust, {b.industry_confidence('p.industry')} AS confidence, {b.industry_evidence(*IND)} AS evidence
  FROM people p) WHERE key IS NOT NULL""")
def _classify_industry(tables):
    from tieline.functions.classify import with_industry

    people = facts_of(tables).people
    return with_industry(people, F.col("industry"), F.col("current_title"), F.col("current_company")).filter(
        "industry_class IS NOT NULL").select("ws", "person_id", "industry_class.*")


def _title_class(name, labels, rules, confidence, key_sql):
    return f""" SELECT employment_id, title, key, {b.label_of('key', labels)} AS label, {confidence} AS confidence, 'inferred' AS trust,
      'Job title “' || trim(title) || '” matched ' || {b.first_pattern('lower(trim(title))', rules)} AS evidence
      FROM (SELECT employment_id, title, {key_sql('title')} AS key FROM employment_all) WHERE key IS NOT NULL"""


@query("classify_role_family", _title_class("role", fv.ROLE_LABELS, fv.ROLE_RULES, "'medium'", b.role_key))
def _classify_role(tables):
    from tieline.functions.classify import with_role_family

    titles = with_role_family(tables.employment.select("title").distinct(), F.col("title")).filter("role_class IS NOT NULL")
    return tables.employment.join(titles, "title").select(
        "employment_id", "title", "role_class.*")


@query("classify_seniority", _title_class("seniority", fv.SENIORITY_LABELS, fv.SENIORITY_RULES,
       "CASE WHEN key IN ('intern', 'c_level', 'founder') THEN 'high' ELSE 'medium' END", b.seniority_key))
def _classify_seniority(tables):
    from tieline.functions.classify import with_seniority

    titles = with_seniority(tables.employment.select("title").distinct(), F.col("title")).filter("seniority_class IS NOT NULL")
    return tables.employment.join(titles, "title").select(
        "employment_id", "title", "seniority_class.*")


@query("parse_location", f""" SELECT ws, person_id, {GEO_COLUMNS}, location AS raw FROM ({GEO})""")
def _parse_location(tables):
    from tieline.functions.classify import with_geo

    return with_geo(facts_of(tables).people, F.col("location")).filter("geo IS NOT NULL").select("ws", "person_id", "geo.*")


@query("fn_share", f""" SELECT ws, company_key, current_count AS numerator, connection_count AS denominator,
  round(CASE WHEN connection_count > 0 THEN current_count * 1.0::DOUBLE / connection_count ELSE 0 END, 9) AS ratio,
  {b.pct('current_count', 'connection_count')} AS percent FROM company_counts""")
def _share(tables):
    from tieline.functions.metrics import share
    from tieline.operators.rollups import company_totals

    counted = company_totals(tables.companies, tables.employment, tables.people)
    return counted.select("ws", "company_key", share(F.col("current_count"), F.col("connection_count")).alias("s")).select(
        "ws", "company_key", "s.*")
