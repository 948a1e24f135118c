"""The table binding as SQL: common table expressions every check query starts from."""

from tieline.functions import fixed_values as fv
from tieline.sources.binding import COMPANY_ENDINGS, COMPANY_NAMES, TITLES


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


SUFFIX_TAIL = "( (" + "|".join(fv.LEGAL_SUFFIXES) + "))+$"


def comparison_key(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def company_key(x: str) -> str:
    return f"regexp_replace({comparison_key(x)}, '{SUFFIX_TAIL}', '')"


def pct(n: str, d: str) -> str:
    return f"(floor((CASE WHEN {d} > 0 THEN {n} * 1.0::DOUBLE / {d} ELSE 0 END) * 100 * 10 + 0.5) / 10)"


def first_rule(text: str, rules) -> str:
    """CASE expression giving the key of the first matching rule."""
    arms = " ".join(f"WHEN regexp_matches({text}, {lit(p)}) THEN {lit(k)}" for p, k in rules)
    return f"CASE {arms} END"


def first_pattern(text: str, rules) -> str:
    arms = " ".join(f"WHEN regexp_matches({text}, {lit(p)}) THEN {lit('/' + p + '/')}" for p, k in rules)
    return f"CASE {arms} END"


def label_of(key: str, labels) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in labels.items())
    return f"CASE {key} {arms} END"


def observed_key(x: str) -> str:
    low = f"lower({x})"
    return (
        f"CASE WHEN regexp_matches({low}, {lit(fv.OBSERVED_TECH)}) THEN "
        f"(CASE WHEN regexp_matches({low}, {lit(fv.OBSERVED_AI)}) THEN 'ai' ELSE 'software' END) "
        f"ELSE {first_rule(low, fv.OBSERVED_INDUSTRY_RULES)} END"
    )


def slug(x: str) -> str:
    return f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 80)"


def industry_key(observed: str, title: str, company: str) -> str:
    t, c = f"lower(coalesce({title}, ''))", f"lower(coalesce({company}, ''))"
    seen = f"trim(coalesce({observed}, ''))"
    return (
        f"CASE WHEN {seen} <> '' THEN coalesce({observed_key(seen)}, {slug(seen)}) "
        f"ELSE coalesce({first_rule(t, fv.TITLE_INDUSTRY_RULES)}, {first_rule(c, fv.COMPANY_INDUSTRY_RULES)}) END"
    )


def industry_label(observed: str, title: str, company: str) -> str:
    seen = f"trim(coalesce({observed}, ''))"
    key = industry_key(observed, title, company)
    return f"CASE WHEN {seen} <> '' AND ({observed_key(seen)}) IS NULL THEN {seen} ELSE {label_of('(' + key + ')', fv.INDUSTRY_LABELS)} END"


def industry_evidence(observed: str, title: str, company: str) -> str:
    t, c = f"lower(coalesce({title}, ''))", f"lower(coalesce({company}, ''))"
    seen = f"trim(coalesce({observed}, ''))"
    return (
        f"CASE WHEN {seen} <> '' THEN 'LinkedIn industry field: “' || {seen} || '”' "
        f"WHEN ({first_rule(t, fv.TITLE_INDUSTRY_RULES)}) IS NOT NULL THEN 'Inferred from job title matching ' || {first_pattern(t, fv.TITLE_INDUSTRY_RULES)} "
        f"ELSE 'Inferred from company name matching ' || {first_pattern(c, fv.COMPANY_INDUSTRY_RULES)} END"
    )


def industry_confidence(observed: str) -> str:
    return f"CASE WHEN trim(coalesce({observed}, '')) <> '' THEN 'high' ELSE 'medium' END"


def industry_trust(observed: str) -> str:
    return f"CASE WHEN trim(coalesce({observed}, '')) <> '' THEN 'observed' ELSE 'inferred' END"


def role_key(title: str) -> str:
    return first_rule(f"lower(trim(coalesce({title}, '')))", fv.ROLE_RULES)


def seniority_key(title: str) -> str:
    return first_rule(f"lower(trim(coalesce({title}, '')))", fv.SENIORITY_RULES)


def country_of(part: str) -> str:
    return label_of(f"lower({part})", fv.COUNTRY_ALIASES)


NOW = "TIMESTAMP '2001-08-02 00:00:00'"
EVENT_NOW = "TIMESTAMP '2024-02-01 00:00:00'"

BASE = f"""
WITH cust AS (
  SELECT r_name AS ws, c_custkey AS person_id, c_name AS name, c_mktsegment AS segment, n_name AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ords AS (
  SELECT o_orderkey AS order_id, o_custkey AS person_id, o_orderdate AS ordered_at,
         o_orderstatus AS order_status, o_orderpriority AS priority FROM orders),
first_line AS (
  SELECT l_orderkey AS order_id, l_suppkey AS supplier, l_partkey AS part FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) = 1),
emp0 AS (
  SELECT c.ws, o.order_id, o.person_id, o.ordered_at, f.supplier,
    {array(TITLES)}[(p_size % {len(TITLES)} + 1)::INT] AS title,
    row_number() OVER (PARTITION BY o.person_id ORDER BY o.ordered_at DESC, o.order_id DESC) = 1 AS is_current,
    CASE WHEN c.ws = 'AFRICA' AND f.supplier % 20 < 17 THEN 0
         WHEN c.ws = 'AMERICA' AND f.supplier % 20 < 12 THEN 0 ELSE f.supplier % 20 END AS company_no
  FROM ords o JOIN first_line f USING (order_id) JOIN cust c USING (person_id) LEFT JOIN part ON p_partkey = f.part),
emp1 AS (
  SELECT *, CASE WHEN order_id % 17 <> 0 THEN
    {array(COMPANY_NAMES)}[(company_no + 1)::INT] || {array(COMPANY_ENDINGS)}[(supplier % 3 + 1)::INT] END AS company_name FROM emp0),
employment_all AS (
  SELECT ws, order_id AS employment_id, person_id, company_name, {company_key('company_name')} AS company_key,
    CASE WHEN company_name IS NOT NULL THEN ws || '/' || {company_key('company_name')} END AS company_id,
    title, ordered_at::DATE AS started_on, date_trunc('year', ordered_at)::TIMESTAMP AS observed_at, is_current FROM emp1),
companies AS (
  SELECT ws, ws || '/' || company_key AS company_id, company_key, arg_min(company_name, employment_id) AS name,
    CASE WHEN length(company_key) % 3 = 0 THEN 'Software' END AS industry
  FROM employment_all WHERE company_key IS NOT NULL GROUP BY ws, company_key),
education_all AS (
  SELECT ws, person_id, 'University of ' || nation AS school FROM cust WHERE person_id % 2 = 0
  UNION ALL SELECT ws, person_id, 'Open Academy' FROM cust WHERE person_id % 7 = 0
  UNION ALL SELECT ws, person_id, 'UNIVERSITY OF ' || nation FROM cust WHERE person_id % 14 = 0),
interactions AS (
  SELECT ws, user_id AS person_id, event_type AS kind, ts AS occurred_at, event_id AS interaction_id
  FROM events JOIN cust ON user_id = person_id),
messages AS (
  SELECT ws, conv_id AS conversation_id, conv_id || '#' || turn AS message_id, text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(conv_id::INT) + to_hours(turn::INT) AS sent_at,
    CASE WHEN role = 'user' THEN 'inbound' ELSE 'outbound' END AS direction
  FROM conversations JOIN cust ON conv_id = person_id WHERE role <> 'system'),
convs AS (
  SELECT DISTINCT ws, conv_id AS conversation_id, person_id,
    CASE WHEN conv_id % 2 = 0 THEN 'Thread ' || conv_id END AS title FROM conversations JOIN cust ON conv_id = person_id),
imports_all AS (
  SELECT DISTINCT ws, ws || '-' || year(ordered_at) AS import_id, make_timestamp(year(ordered_at), 12, 31, 0, 0, 0) AS uploaded_at,
    CASE year(ordered_at) WHEN 1996 THEN 'failed' WHEN 1998 THEN 'partially_completed' WHEN 1995 THEN 'processing' ELSE 'completed' END AS status,
    'export-' || year(ordered_at) || '.zip' AS filename,
    CASE WHEN year(ordered_at) = 1999 THEN 'messages' ELSE 'connections' END AS dataset
  FROM ords JOIN cust USING (person_id)),
person_tags AS (SELECT DISTINCT ws, person_id, priority AS tag FROM ords JOIN cust USING (person_id)),
tags AS (SELECT DISTINCT ws, tag FROM person_tags UNION ALL SELECT DISTINCT ws, 'unused' FROM cust),
jobs AS (
  SELECT e.ws, employment_id AS job_id, coalesce(title, company_name) AS title, company_name, company_id,
    CASE WHEN employment_id % 3 <> 0 THEN ordered_at END AS applied_at, CASE WHEN employment_id % 2 = 0 THEN ordered_at END AS saved_at
  FROM employment_all e JOIN ords ON order_id = employment_id WHERE order_status = 'P'),
touch AS (
  SELECT person_id, sum(hits)::BIGINT AS interaction_count, max(last_at) AS last_interaction_at FROM (
    SELECT c.person_id, count(*) AS hits, max(sent_at) AS last_at FROM convs c JOIN messages m USING (conversation_id) GROUP BY 1
    UNION ALL SELECT person_id, count(*), max(occurred_at) FROM interactions GROUP BY 1) GROUP BY 1),
spans AS (
  SELECT person_id, arg_min(ordered_at, order_id) AS first_ordered, year(min(ordered_at)) AS first_year, year(max(ordered_at)) AS last_year
  FROM ords GROUP BY 1),
people_all AS (
  SELECT c.ws, c.person_id, c.name, split_part(c.name, '#', 1) AS first_name, split_part(c.name, '#', 2) AS last_name,
    CASE WHEN e.title IS NOT NULL AND e.company_name IS NOT NULL THEN e.title || ' at ' || e.company_name ELSE e.title END AS headline,
    e.company_name AS current_company, e.title AS current_title,
    CASE c.person_id % 4 WHEN 1 THEN nation || ', ' || c.ws WHEN 2 THEN nation || ', CA, US' WHEN 3 THEN 'UK' END AS location,
    CASE c.person_id % 9 WHEN 0 THEN segment WHEN 3 THEN 'Hospital & Health Care' WHEN 6 THEN 'Computer Software' END AS industry,
    CASE WHEN c.person_id % 5 <> 0 THEN 'https://www.linkedin.com/in/c' || (CASE WHEN c.person_id % 50 = 2 THEN c.person_id - 1 ELSE c.person_id END) END AS profile_url,
    CASE WHEN c.person_id % 3 = 0 THEN 'c' || c.person_id || '@example.com' END AS email,
    CASE WHEN c.person_id % 10 <> 9 THEN first_ordered END AS connected_at,
    coalesce(t.interaction_count, 0) AS interaction_count, t.last_interaction_at,
    c.person_id = min(c.person_id) OVER (PARTITION BY c.ws) AS is_self,
    c.ws || '-' || first_year AS first_import_id, c.ws || '-' || last_year AS last_import_id
  FROM cust c LEFT JOIN spans USING (person_id) LEFT JOIN touch t USING (person_id)
  LEFT JOIN employment_all e ON e.person_id = c.person_id AND e.is_current),
owners AS (SELECT ws, person_id, industry, location FROM people_all WHERE is_self),
owner_companies AS (SELECT DISTINCT e.ws, company_key FROM employment_all e JOIN owners USING (ws, person_id) WHERE company_key IS NOT NULL),
owner_schools AS (SELECT DISTINCT e.ws, lower(school) AS school_key FROM education_all e JOIN owners USING (ws, person_id)),
people AS (
  SELECT p.*, e.company_key AS current_company_key, e.company_id AS current_company_id
  FROM people_all p LEFT JOIN employment_all e ON e.person_id = p.person_id AND e.is_current WHERE NOT is_self),
employment AS (SELECT e.* FROM employment_all e ANTI JOIN owners USING (ws, person_id)),
education AS (SELECT e.* FROM education_all e ANTI JOIN owners USING (ws, person_id)),
imports AS (SELECT *, dataset = 'connections' AS had_connections FROM imports_all WHERE status IN ('completed', 'partially_completed')),
sizes AS (SELECT ws, count(*) AS total FROM people GROUP BY ws),
company_counts AS (
  SELECT c.*, coalesce(x.connection_count, 0) AS connection_count, coalesce(x.current_count, 0) AS current_count, coalesce(x.former_count, 0) AS former_count
  FROM companies c LEFT JOIN (
    SELECT company_id, count(DISTINCT person_id) AS connection_count, count(DISTINCT person_id) FILTER (is_current) AS current_count,
      count(DISTINCT person_id) FILTER (NOT is_current) AS former_count FROM employment GROUP BY 1) x USING (company_id))
"""
