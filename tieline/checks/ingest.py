"""Queries over sources, dataset normalisers, identity, merges and maintenance.

Files, archives and raw rows are derived from the bound tables by Spark, then read back by the operators."""

import csv
import io
import zipfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import functions as F

from tieline.checks import base_sql as b
from tieline.checks.registry import query
from tieline.checks.text import SQUASH
from tieline.functions import text as t
from tieline.operators import exports, identity, maintenance as mt, merge, normalize as nz
from tieline.operators.merge import dedupe_first
from tieline.sources import archive, catalogue, delimited
from tieline.session import checkpoint_dir
from tieline.sources.binding import pick, spread, written

IMPORT = "i1"


def raw_rows(df, dataset, number, cells, ws="ws", source=None):
    """Raw rows as the file scan would give them: cells by header, as text."""
    cells = F.create_map(*[x for h, c in cells.items() for x in (F.lit(h), F.coalesce(c.cast("string"), F.lit("")))])
    return df.select(F.col(ws).cast("string").alias("ws"), F.lit(IMPORT).alias("import_id"), (F.lit(dataset + ".csv") if source is None else source).alias("source_file"),
                     number.cast("long").alias("row_no"), cells.alias("row"), F.lit(dataset).alias("dataset"))


def run(step, raw, owner_raw=None):
    """The canonical tables of raw rows, which are written before they are read: the operators look at a row's cells many times over, and a table
    of few bytes would be normalised by one task."""
    out = nz.Canonical()
    base = raw if owner_raw is None else raw.unionByName(owner_raw)
    base = written(base.repartition("ws", "source_file", "row_no"), f"{checkpoint_dir(base.sparkSession)}/tieline/raw-{uuid4().hex}")
    step(base, nz.owners(base), out)
    return out


def owner_profile(tables):
    """A Profile.csv row per workspace, for rules that need the owner."""
    owners = tables.people.filter("is_self")
    return raw_rows(owners, "profile", F.lit(1), {"first name": F.col("first_name"), "last name": F.col("last_name"), "url": F.lit("linkedin.com/in/owner")})


# --- files -------------------------------------------------------------------------------------------

ENTRY_NAMES = ["Connections.csv", "jobs/Saved Jobs.csv", "../../evil.csv", "/etc/evil.csv", "__MACOSX/._Connections.csv", ".DS_Store", "nested.zip",
               "a/b/c/d/e/f/g/h/i/j/k/l/m/deep.csv", "Ads Clicked.csv", "holiday.jpg"]


def derived_files(tables):
    """(ws, import_id, archive, content, damaged): one ZIP per 50 customers, whose Connections.csv lists them.
    Customers are dealt to archives by key, so an archive's size is fixed."""
    people = tables.table("customer").select((F.col("c_custkey") / 50).cast("long").alias("no"), "c_custkey", "c_name", "c_mktsegment")
    lines = people.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("rows"))

    def build(batches):
        for batch in batches:
            out = []
            for item in batch.to_pylist():
                text = io.StringIO()
                writer = csv.writer(text, lineterminator="\n", delimiter=";" if item["no"] % 3 == 0 else ",")
                text.write("Notes:\n\"About this; file, and more\"\n\n")
                writer.writerow(["First Name", "Last Name", "URL", "Company", "Connected On"])
                for r in item["rows"]:
                    key = r["c_custkey"]
                    extra = ["surplus"] if key % 7 == 0 else []
                    writer.writerow(["Customer", r["c_name"][9:], f"https://www.linkedin.com/in/c{key}", f"{r['c_mktsegment']}, \"{key % 5}\"\nInc", "05 Mar 2024", *extra])
                    if key % 10 == 0:
                        writer.writerow(["", " ", "", "", ""])
                held = io.BytesIO()
                encoded = text.getvalue().encode("utf-16-le") if item["no"] % 4 == 1 else text.getvalue().encode()
                encoded = (b"\xff\xfe" if item["no"] % 4 == 1 else b"") + encoded
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for name in ENTRY_NAMES:
                        z.writestr(zipfile.ZipInfo(name), encoded if name == "Connections.csv" else b"Saved Date,Job Title\n2024-01-01,Clerk\n")
                content = held.getvalue()
                if item["no"] % 9 == 8:
                    content = content[: len(content) // 2]
                out.append({"ws": f"w{item['no']}", "import_id": "i1", "archive": f"export-{item['no']}.zip", "content": content})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("ws", pa.string()), ("import_id", pa.string()), ("archive", pa.string()), ("content", pa.binary())]))

    return lines.mapInArrow(build, "ws string, import_id string, archive string, content binary")


REASONS = {"../../evil.csv": "Path traversal entry rejected", "/etc/evil.csv": "Absolute paths are not allowed", "__MACOSX/._Connections.csv": "System file ignored",
           ".DS_Store": "System file ignored", "nested.zip": "Nested archives are not extracted", ENTRY_NAMES[7]: "Nested too deeply"}
ENTRY_VALUES = ", ".join(f"({b.lit(n)}, {b.lit(n.split('/')[-1])}, {b.lit(REASONS.get(n))})" for n in ENTRY_NAMES)
SKIPS = "CASE entry WHEN 'Ads Clicked.csv' THEN 'Advertising data — not imported by design' WHEN 'holiday.jpg' THEN '.jpg is not a LinkedIn data file' END"


@query("archive_entries", f"""WITH a AS (SELECT DISTINCT c_custkey // 50 AS no FROM customer)
  SELECT 'w' || no AS ws, entry AS entry_path, filename, CASE WHEN reason IS NULL THEN {SKIPS} ELSE reason END AS reason, NULL AS error_code FROM a CROSS JOIN (VALUES {ENTRY_VALUES}) v(entry, filename, reason) WHERE no % 9 <> 8
  UNION ALL SELECT 'w' || no, NULL, NULL, NULL, 'MALFORMED_ARCHIVE' FROM a WHERE no % 9 = 8""", base=False)
def _entries(tables):
    found = archive.archive_entries(derived_files(tables))
    read = F.col("reject_reason").isNull() & F.col("error_code").isNull()
    skip = F.when(read, catalogue.skip_reason(F.col("filename"), F.col("extension")))
    return found.select("ws", "entry_path", "filename", F.coalesce("reject_reason", skip).alias("reason"), "error_code")


def scanned(tables):
    found = archive.archive_entries(derived_files(tables)).filter("filename = 'Connections.csv' AND content IS NOT NULL")
    return delimited.scan_files(found.withColumn("source_file", F.col("entry_path")))


@query("csv_rows", """SELECT 'w' || (c_custkey // 50) AS ws, row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS row_no, 'Customer' AS first_name, c_name[10:] AS last_name,
  c_mktsegment || ', "' || (c_custkey % 5) || '" Inc' AS company, '05 Mar 2024' AS connected_on, '' AS missing FROM customer WHERE (c_custkey // 50) % 9 <> 8""", base=False)
def _csv(tables):
    cell = lambda h: F.coalesce(F.try_element_at("row", F.lit(h)), F.lit(""))
    return delimited.numbered_rows(scanned(tables)).select(
        "ws", "row_no", cell("first name").alias("first_name"), cell("last name").alias("last_name"), cell("company").alias("company"),
        cell("connected on").alias("connected_on"), cell("nothing").alias("missing"))


@query("row_hygiene", """SELECT 'w' || no AS ws, CASE WHEN no % 3 = 0 THEN ';' ELSE ',' END AS delimiter, CASE WHEN no % 4 = 1 THEN 'utf16le' ELSE 'utf8' END AS encoding, count(*) AS row_count,
  count(*) FILTER (c_custkey % 10 = 0) AS skipped_rows, 1 + count(*) FILTER (c_custkey % 7 = 0) AS warnings, 'first name|last name|url|company|connected on' AS header
  FROM (SELECT *, c_custkey // 50 AS no FROM customer) WHERE no % 9 <> 8 GROUP BY no""", base=False)
def _hygiene(tables):
    return delimited.file_summaries(scanned(tables)).select(
        "ws", "delimiter", "encoding", "row_count", "skipped_rows", F.size("warnings").cast("long").alias("warnings"), F.array_join("header_keys", "|").alias("header"))


@query("delimiter_detect", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter FROM customer""", base=False)
def _delimiter(tables):
    d = pick([",", ";", "\t", "|"], F.col("c_custkey") % 4)
    line = F.concat(F.lit('"a,b;c"'), d, F.col("c_name"), d, F.col("c_mktsegment"))
    return spread(tables.table("customer").select("c_custkey", "c_name", "c_mktsegment")).select("c_custkey", delimited.delimiter_of(F.concat(line, F.lit("\r\n\n"), line)).alias("delimiter"))


FILES = ["Connections.csv", "Job Applications.csv", "export (1).csv", "renamed.csv", "budget.csv", "VOTES.csv", "Honors & Awards.csv", "PhoneNumbers.csv"]
HEADERS = [["first name"], [], ["first name", "last name", "url", "company", "connected on"], ["from", "to", "date", "content"], ["month", "amount"], [], [], ["name", "authority", "proficiency"]]
DATASETS = ["connections", "job_applications", "connections", "messages", None, "reactions", "honors", "phone_numbers"]


@query("dataset_detect", f"""SELECT page_id, CASE WHEN page_id % 16 >= 8 THEN {b.array(['connections' if i == 0 else d for i, d in enumerate([None, None, 'connections', 'messages', None, None, None, 'certifications'])]).replace("'connections', NULL", "NULL, NULL", 1)}[(page_id % 8 + 1)::INT]
  ELSE {b.array(DATASETS)}[(page_id % 8 + 1)::INT] END AS dataset FROM pages""", base=False)
def _dataset(tables):
    no = F.col("page_id") % 8
    name = F.when(F.col("page_id") % 16 >= 8, F.concat(F.lit("x"), F.col("page_id").cast("string"))).otherwise(pick(FILES, no))
    keys = F.get(F.array(*[F.array(*[F.lit(k) for k in h]).cast("array<string>") for h in HEADERS]), no.cast("int"))
    return tables.table("pages").select("page_id", catalogue.detect_dataset(name, keys).alias("dataset"))


@query("import_checksum", """SELECT 'w' || (page_id // 20) AS ws, sha256(string_agg(filename || digest, '' ORDER BY filename, digest)) AS checksum
  FROM (SELECT page_id, 'page-' || page_id || '.html' AS filename, sha256(html) AS digest FROM pages) GROUP BY page_id // 20""", base=False)
def _checksum(tables):
    files = tables.table("pages").select(
        F.concat(F.lit("w"), (F.col("page_id") / 20).cast("long").cast("string")).alias("ws"), F.lit(IMPORT).alias("import_id"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.col("html").cast("binary").alias("content"))
    return archive.upload_checksums(files).drop("import_id")


# --- normalisers -----------------------------------------------------------------------------------------


def connection_raw(tables):
    c = F.col
    return raw_rows(tables.people.filter("NOT is_self"), "connections", c("person_id"), {
        "first name": c("first_name"), "last name": c("last_name"),
        "url": F.concat(F.replace(F.replace("profile_url", F.lit("/in/c"), F.lit("/in/C")), F.lit("www"), F.lit("uk")), F.lit("?trk=x")),
        "email address": F.upper("email"), "company": c("current_company"), "position": F.concat("current_title", F.lit(" -")),
        "connected on": F.date_format("connected_at", "dd MMM yyyy")})


KEYED = f"""SELECT *, CASE WHEN profile_url IS NOT NULL THEN 'url:' || split_part(profile_url, '/in/', 2) WHEN email IS NOT NULL THEN 'email:' || email
  WHEN current_company_key IS NOT NULL THEN 'nc:customer ' || last_name || '|' || current_company_key ELSE 'name:customer ' || last_name END AS person_key FROM people"""


@query("norm_connections", f""" SELECT ws, person_key, min(connected_at) AS connected_at, count(*) AS rows, arg_min(first_name || ' ' || last_name, person_id) AS name, arg_min(headline, person_id) FILTER (headline IS NOT NULL) AS headline,
  max(CASE WHEN profile_url IS NOT NULL THEN 100 WHEN email IS NOT NULL THEN 95 ELSE 80 END)::INT AS confidence FROM ({KEYED}) GROUP BY 1, 2""")
def _connections(tables):
    out = run(nz.normalize_connections, connection_raw(tables))
    people = out.union("people")
    rows = people.groupBy("ws", "person_key").agg(F.count(F.lit(1)).alias("rows"))
    merged = identity.merge_people(people).select("ws", "person_key", "name", "headline", "confidence")
    return out.union("connections").select("ws", "person_key", "connected_at").join(merged, ["ws", "person_key"]).join(rows, ["ws", "person_key"])


@query("norm_positions", """ SELECT ws, employment_id AS row_no, company_name, title, strftime(started_on, '%b %Y') AS start_date, date_trunc('month', started_on)::DATE AS started_on,
  CASE WHEN NOT is_current THEN date_trunc('year', started_on)::DATE END AS ended_on, is_current FROM employment_all WHERE company_name IS NOT NULL OR title IS NOT NULL""")
def _positions(tables):
    c = F.col
    raw = raw_rows(tables.employment, "positions", c("employment_id"), {
        "company name": c("company_name"), "title": c("title"), "started on": F.date_format("started_on", "MMM yyyy"),
        "finished on": F.when(~c("is_current"), F.date_format("started_on", "yyyy"))})
    return run(nz.normalize_positions, raw).union("employment").select(
        "ws", "ord.row_no", "company_name", "title", "start_date", "started_on", "ended_on", "is_current")


@query("norm_volunteering", """ SELECT ws, employment_id AS row_no, company_name, coalesce(title || ' (volunteer)', 'Volunteer') AS title FROM employment_all WHERE company_name IS NOT NULL OR title IS NOT NULL""")
def _volunteering(tables):
    raw = raw_rows(tables.employment, "volunteering", F.col("employment_id"), {"organization": F.col("company_name"), "role": F.col("title")})
    return run(nz.normalize_volunteering, raw).union("employment").select("ws", "ord.row_no", "company_name", "title")


@query("norm_education", """ SELECT ws, person_id AS row_no, school, CASE WHEN person_id % 3 = 0 THEN 'BSc' END AS degree FROM education_all WHERE person_id % 10 <> 4""")
def _education(tables):
    schools = F.when(F.col("person_id") % 10 == 4, F.lit("N/A")).otherwise(F.col("school"))
    raw = raw_rows(tables.education, "education", F.col("person_id"), {"school name": schools, "degree name": F.when(F.col("person_id") % 3 == 0, "BSc").otherwise("-")})
    return run(nz.normalize_education, raw).union("education").select("ws", "ord.row_no", "school", "degree")


@query("norm_skills", "SELECT p_partkey AS row_no, p_name AS skill, p_size::INT AS points FROM part WHERE p_partkey % 6 <> 0", base=False)
def _skills(tables):
    part = tables.table("part").withColumn("ws", F.lit("w"))
    raw = raw_rows(part, "skills", F.col("p_partkey"), {"name": F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")), "endorsements": F.concat(F.col("p_size").cast("string"), F.lit(" times"))})
    return run(nz.normalize_skills, raw).union("skills").select("ord.row_no", "skill", "points")


@query("norm_contacts", """SELECT c_custkey AS row_no, 'email' AS kind, 'c' || c_custkey || '@example.com' AS value, c_custkey % 3 = 0 AS is_primary FROM customer WHERE c_custkey % 4 <> 3
  UNION ALL SELECT c_custkey, 'phone', '+1415555' || c_custkey, NULL FROM customer""", base=False)
def _contacts(tables):
    rows = tables.table("customer").withColumn("ws", F.lit("w"))
    key = F.col("c_custkey").cast("string")
    mails = raw_rows(rows, "email_addresses", F.col("c_custkey"), {"email address": F.concat(F.lit("C"), key, F.when(F.col("c_custkey") % 4 != 3, "@example.com").otherwise("@nowhere")),
                                                                 "primary": pick(["YES, always", "No", "no"], F.col("c_custkey") % 3)})
    phones = raw_rows(rows, "phone_numbers", F.col("c_custkey"), {"number": F.concat(F.lit("+1 (415) 555-"), key), "type": F.lit("mobile")})
    out = run(nz.normalize_contacts, mails.unionByName(phones))
    return out.union("emails").select("ord.row_no", F.lit("email").alias("kind"), F.col("email").alias("value"), "is_primary").unionByName(
        out.union("phone_numbers").select("ord.row_no", F.lit("phone").alias("kind"), F.col("phone_number").alias("value"), F.lit(None).cast("boolean").alias("is_primary")))


@query("norm_profile", """SELECT c_custkey::VARCHAR AS ws, CASE WHEN c_custkey % 2 = 0 THEN 'url:c' || c_custkey ELSE 'self' END AS person_key, replace(c_name, '#', ' ') AS name, c_mktsegment AS industry,
  'Paris, France' AS location, c_mktsegment || ' summary' AS summary FROM customer""", base=False)
def _profile(tables):
    c = F.col
    rows = tables.table("customer").withColumn("copies", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    first = F.when(c("copies") == 1, "").otherwise(F.split("c_name", "#")[0])
    raw = raw_rows(rows, "profile", c("copies"), {
        "first name": first, "last name": F.when(c("copies") > 1, F.concat(F.split("c_name", "#")[1], F.when(c("copies") == 3, "x").otherwise(""))),
        "industry": c("c_mktsegment"), "geo location": F.lit("Paris ,, France"), "summary": F.concat("c_mktsegment", F.lit("  summary")), "maiden name": F.lit("n/a"),
        "url": F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("linkedin.com/in/C"), c("c_custkey").cast("string")))}, ws="c_custkey")
    out = run(nz.normalize_profile, raw)
    fields = out.union("profile_fields").filter("field_name = 'summary'").select("ws", F.col("field_value").alias("summary"))
    return out.union("people").select("ws", "person_key", "name", "industry", "location").join(fields, "ws", "left")


@query("norm_profile_lists", """, named AS (SELECT ws, person_id, employment_id, CASE WHEN company_name IS NOT NULL AND title IS NOT NULL THEN title || ' — ' || company_name ELSE title END AS v FROM employment_all)
  SELECT person_id::VARCHAR AS ws, string_agg(v, '; ' ORDER BY employment_id) AS field_value FROM named WHERE v IS NOT NULL GROUP BY person_id""")
def _lists(tables):
    raw = raw_rows(tables.employment, "certifications", F.col("employment_id"), {"name": F.col("title"), "authority": F.col("company_name")}, ws="person_id")
    return run(nz.normalize_profile_lists, raw).union("profile_fields").select("ws", "field_value")


@query("norm_invitations", """ SELECT i.ws, interaction_id AS row_no, CASE WHEN interaction_id % 5 = 0 THEN 'url:c' || person_id ELSE 'name:customer ' || right(name, 9) END AS person_key,
  date_trunc('second', occurred_at)::TIMESTAMP AS occurred_at FROM interactions i JOIN cust USING (ws, person_id)""")
def _invitations(tables):
    c = F.col
    rows = tables.interactions.join(tables.people.select("ws", "person_id", "name"), ["ws", "person_id"]).join(
        tables.people.filter("is_self").select("ws", c("name").alias("owner")), "ws")
    sent = c("interaction_id") % 2 == 0
    label = F.when(sent, F.when(c("interaction_id") % 4 == 0, "outgoing").otherwise("")).otherwise("INCOMING")
    raw = raw_rows(rows, "invitations", c("interaction_id"), {
        "from": F.when(sent, F.replace("owner", F.lit("#"), F.lit(" "))).otherwise(F.replace("name", F.lit("#"), F.lit(" "))),
        "to": F.when(sent, F.replace("name", F.lit("#"), F.lit(" "))).otherwise(F.replace("owner", F.lit("#"), F.lit(" "))), "direction": label,
        "sent at": F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"),
        "inviteeprofileurl": F.when(sent & (c("interaction_id") % 5 == 0), F.concat(F.lit("linkedin.com/in/c"), c("person_id").cast("string"))),
        "inviterprofileurl": F.when(~sent & (c("interaction_id") % 5 == 0), F.concat(F.lit("linkedin.com/in/c"), c("person_id").cast("string")))})
    return run(nz.normalize_invitations, raw, owner_profile(tables)).union("interactions").select("ws", "ord.row_no", "person_key", "occurred_at")


@query("norm_endorsements", """ SELECT ws, employment_id AS row_no, CASE WHEN employment_id % 3 = 0 THEN NULL ELSE 'name:customer ' || right(name, 9) END AS person_key, title AS skill FROM employment_all JOIN cust USING (ws, person_id)
  WHERE title IS NOT NULL OR employment_id % 3 <> 0""")
def _endorsements(tables):
    rows = tables.employment.join(tables.people.select("ws", "person_id", "first_name", "last_name"), ["ws", "person_id"])
    known = F.col("employment_id") % 3 != 0
    raw = raw_rows(rows, "endorsements_received", F.col("employment_id"), {
        "endorser first name": F.when(known, F.col("first_name")), "endorser last name": F.when(known, F.col("last_name")), "skill name": F.col("title")})
    out = run(nz.normalize_endorsements, raw)
    skills = out.union("skills").select("ws", "ord.row_no", "skill")
    return out.union("interactions").select("ws", "ord.row_no", "person_key").join(skills, ["ws", "row_no"], "full").select("ws", "row_no", "person_key", "skill")


@query("norm_recommendations", """ SELECT ws, employment_id AS row_no, CASE WHEN employment_id % 2 = 0 THEN 'recommendation_received' ELSE 'recommendation_given' END AS kind,
  CASE WHEN company_key IS NOT NULL THEN 'nc:customer ' || right(name, 9) || '|' || company_key ELSE 'name:customer ' || right(name, 9) END AS person_key, started_on::TIMESTAMP AS occurred_at FROM employment_all JOIN cust USING (ws, person_id)""")
def _recommendations(tables):
    rows = tables.employment.join(tables.people.select("ws", "person_id", "first_name", "last_name"), ["ws", "person_id"])
    cells = {"first name": F.col("first_name"), "last name": F.col("last_name"), "company": F.col("company_name"), "job title": F.col("title"), "creation date": F.col("started_on")}
    even, odd = rows.filter("employment_id % 2 = 0"), rows.filter("employment_id % 2 = 1")
    raw = raw_rows(even, "recommendations_received", F.col("employment_id"), cells).unionByName(raw_rows(odd, "recommendations_given", F.col("employment_id"), cells))
    return run(nz.normalize_recommendations, raw).union("interactions").select("ws", "ord.row_no", "kind", "person_key", "occurred_at")


def message_raw(tables):
    c = F.col
    rows = tables.table("conversations").join(tables.people.select("ws", c("person_id").alias("conv_id"), "name", "profile_url"), "conv_id").join(
        tables.people.filter("is_self").select("ws", c("name").alias("owner")), "ws")
    mine = c("role") == "assistant"
    named = lambda x: F.replace(x, F.lit("#"), F.lit(" "))
    return raw_rows(rows, "messages", c("conv_id") * 1000 + c("turn"), {
        "conversation id": F.when(c("conv_id") % 3 != 0, F.concat(F.lit("c-"), c("conv_id").cast("string"))), "content": c("text"),
        "from": F.when(mine, named("owner")).otherwise(named("name")), "to": F.when(mine, named("name")).otherwise(named("owner")),
        "folder": F.when(mine & (c("conv_id") % 2 == 0), "sent"), "sender profile url": F.when(~mine, c("profile_url")),
        "date": F.date_format(F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(c("conv_id").cast("int"), c("turn").cast("int")), "yyyy-MM-dd HH:mm:ss 'UTC'")})


TALK_KEY = "CASE WHEN conv_id % 3 <> 0 THEN 'c-' || conv_id ELSE 'counterpart:customer ' || right(name, 9) END"


@query("norm_messages", f""" SELECT ws, conv_id * 1000 + turn AS row_no, {TALK_KEY} AS conversation_key, CASE WHEN role = 'assistant' OR (conv_id = owner_id AND conv_id % 5 = 0) THEN 'outbound' ELSE 'inbound' END AS direction,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(conv_id::INT) + to_hours(turn::INT) AS sent_at, 'Customer ' || right(CASE WHEN role = 'assistant' THEN name ELSE owner_name END, 9) AS recipient_name,
  {SQUASH('text')} AS content, concat_ws('#', conversation_key, strftime(sent_at, '%Y-%m-%dT%H:%M:%S.000Z'), sha256({SQUASH('text')})) AS external_id
  FROM conversations JOIN cust ON conv_id = person_id JOIN (SELECT ws, name AS owner_name, person_id AS owner_id FROM people_all WHERE is_self) USING (ws)""")
def _messages(tables):
    return run(nz.normalize_messages, message_raw(tables), owner_profile(tables)).union("messages").select(
        "ws", "ord.row_no", "conversation_key", "direction", "sent_at", "recipient_name", "content", "external_id")


@query("norm_activities", f"""SELECT doc_id AS row_no, CASE doc_id % 3 WHEN 0 THEN 'comment' WHEN 1 THEN 'reaction' ELSE 'share' END AS activity_type, nullif({SQUASH('text')}, '') AS content,
  'https://example.com/' || doc_id AS content_url, activity_type || ':' || content_url || ':2024-03-05T00:00:00.000Z:' || sha256(coalesce(content, '')) AS external_id,
  make_timestamp(2024, 3, 5, 0, 0, 0) AS created_at FROM documents""", base=False)
def _activities(tables):
    docs = tables.table("documents").withColumn("ws", F.lit("w"))
    url = F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))
    parts = [("comments", "comment", "link"), ("reactions", "type", "url"), ("shares", "sharecommentary", "sharedurl")]
    raw = None
    for i, (dataset, content, link) in enumerate(parts):
        part = raw_rows(docs.filter(F.col("doc_id") % 3 == i), dataset, F.col("doc_id"), {content: F.col("text"), link: url, "date": F.lit("March 5, 2024")})
        raw = part if raw is None else raw.unionByName(part)
    return run(nz.normalize_activities, raw).union("activities").select("ord.row_no", "activity_type", "content", "content_url", "created_at", "external_id")


@query("norm_jobs", f""" SELECT ws, 'application:' || coalesce({b.comparison_key('company_name')}, '') || '|' || coalesce({b.comparison_key('title')}, '') || '|' AS external_id, min(title) AS title, count(*) AS rows
  FROM (SELECT ws, company_name, coalesce(title, company_name) AS shown, title, employment_id FROM employment_all WHERE company_name IS NOT NULL OR title IS NOT NULL) GROUP BY ws, external_id""".replace("min(title) AS title", "arg_min(shown, employment_id) AS title"))
def _jobs(tables):
    raw = raw_rows(tables.employment, "job_applications", F.col("employment_id"), {"company name": F.col("company_name"), "job title": F.col("title"), "application date": F.lit("2/14/26")})
    rows = run(nz.normalize_jobs, raw).union("job_rows")
    counts = rows.groupBy("ws", "external_id").agg(F.count(F.lit(1)).alias("rows"))
    return nz.merge_jobs(rows).select("ws", "external_id", "title").join(counts, ["ws", "external_id"])


@query("norm_company_follows", """ SELECT DISTINCT ws, company_key FROM employment_all WHERE company_key IS NOT NULL""")
def _follows(tables):
    raw = raw_rows(tables.employment, "company_follows", F.col("employment_id"), {"organization": F.col("company_name")})
    return identity.merge_companies(run(nz.normalize_company_follows, raw).union("companies")).select("ws", "company_key")


@query("company_merge", """ SELECT ws, company_key, arg_min(company_name, employment_id) AS name FROM employment_all WHERE company_key IS NOT NULL GROUP BY 1, 2""")
def _company_merge(tables):
    raw = raw_rows(tables.employment, "positions", F.col("employment_id"), {"company": F.col("company_name")})
    return identity.merge_companies(run(nz.normalize_positions, raw).union("companies")).select("ws", "company_key", "name")


# --- identity ------------------------------------------------------------------------------------------------


@query("person_key", f" SELECT ws, person_id, person_key FROM ({KEYED})")
def _person_key(tables):
    from tieline.sources.facts import facts_of

    people = facts_of(tables).people
    key = identity.person_key(F.col("profile_url"), F.col("email"), F.replace("name", F.lit("#"), F.lit(" ")), F.col("current_company"))
    return people.select("ws", "person_id", key.alias("person_key"))


def candidate_people(tables):
    """Two strong and one weak sighting per customer name; names repeat over keys 1000 apart."""
    c = F.col
    base = tables.people.select("ws", F.lit(IMPORT).alias("import_id"), c("person_id"), F.concat(F.lit("Person "), (c("person_id") % 400).cast("string")).alias("name"), "industry", "location", "email")
    null = lambda kind="string": F.lit(None).cast(kind)
    rows = base.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    key = F.when(c("copy") == 0, F.concat(F.lit("url:"), c("person_id").cast("string"))).otherwise(F.concat(F.lit("name:"), F.lower("name")))
    rows = rows.filter((c("copy") == 1) | (c("person_id") % 5 != 0)).withColumn("person_key", key).withColumn("ord", F.struct(c("copy").alias("rank"), F.lit("f").alias("source_file"), c("person_id").alias("row_no")))
    empty = {x: null() for x in ("first_name", "last_name", "headline", "profile_url", "current_company", "current_title")}
    return rows.withColumns({**empty, "connected_at": null("timestamp_ntz"), "is_self": F.lit(False), "confidence": F.when(c("copy") == 0, 90).otherwise(60), "source_file": F.lit("f"),
                             "industry": F.when(c("copy") == 1, c("industry")), "location": F.when(c("copy") == 0, c("location"))})


SIGHTED = """, seen AS (SELECT ws, person_id, 'Person ' || (person_id % 400) AS name, CASE WHEN copy = 1 THEN industry END AS industry, CASE WHEN copy = 0 THEN location END AS location, email, copy,
    CASE WHEN copy = 0 THEN 'url:' || person_id ELSE 'name:person ' || (person_id % 400) END AS person_key FROM people_all CROSS JOIN (VALUES (0), (1)) v(copy) WHERE copy = 1 OR person_id % 5 <> 0),
  merged AS (SELECT ws, person_key, arg_min(name, (copy, person_id)) AS name, arg_min(industry, (copy, person_id)) FILTER (industry IS NOT NULL) AS industry, arg_min(location, (copy, person_id)) FILTER (location IS NOT NULL) AS location,
    arg_min(email, (copy, person_id)) FILTER (email IS NOT NULL) AS email, max(CASE WHEN copy = 0 THEN 90 ELSE 60 END)::INT AS confidence, min((copy, person_id)) AS ord FROM seen GROUP BY 1, 2),
  remap AS (SELECT ws, w.person_key, strong_key FROM merged w JOIN (SELECT ws, name, min(person_key) AS strong_key FROM merged WHERE person_key LIKE 'url:%' GROUP BY 1, 2 HAVING count(*) = 1) s USING (ws, name) WHERE w.person_key LIKE 'name:%')"""


@query("person_merge", SIGHTED + " SELECT ws, person_key, name, industry, location, email, confidence FROM merged")
def _merge_people(tables):
    return identity.merge_people(candidate_people(tables)).select("ws", "person_key", "name", "industry", "location", "email", "confidence")


@query("reconcile_weak", SIGHTED + """ SELECT ws, coalesce(strong_key, person_key) AS person_key, arg_min(name, (strong_key IS NOT NULL, ord)) AS name, arg_min(industry, (strong_key IS NOT NULL, ord)) FILTER (industry IS NOT NULL) AS industry,
  arg_min(location, (strong_key IS NOT NULL, ord)) FILTER (location IS NOT NULL) AS location, arg_min(email, (strong_key IS NOT NULL, ord)) FILTER (email IS NOT NULL) AS email,
  arg_min(confidence, (strong_key IS NOT NULL, ord)) AS confidence FROM merged LEFT JOIN remap USING (ws, person_key) GROUP BY ws, coalesce(strong_key, person_key)""")
def _reconcile(tables):
    people = identity.merge_people(candidate_people(tables))
    return identity.reconcile_people(people, identity.weak_to_strong(people)).select("ws", "person_key", "name", "industry", "location", "email", "confidence")


@query("reconcile_stored", SIGHTED + " SELECT * FROM remap")
def _stored(tables):
    people = identity.merge_people(candidate_people(tables))
    return identity.weak_to_stored(people, people.filter(identity.is_strong(F.col("person_key")))).drop("import_id")


@query("resolve_counterparts", """, named AS (SELECT ws, lower(name) AS n, min(person_id) AS id FROM people_all GROUP BY 1, 2 HAVING count(*) = 1)
  SELECT c.ws, conversation_id, CASE WHEN conversation_id % 5 NOT IN (0) AND conversation_id % 50 <> 2 AND conversation_id % 2 = 0 THEN c.person_id WHEN conversation_id % 3 <> 0 THEN n.id END AS person_id
  FROM convs c LEFT JOIN cust p ON p.person_id = c.person_id LEFT JOIN named n ON n.ws = c.ws AND n.n = lower(p.name)""")
def _counterparts(tables):
    c = F.col
    people = tables.people.withColumn("person_key", F.concat(F.lit("url:"), F.when(c("person_id") % 50 != 2, F.replace("profile_url", F.lit("https://www.linkedin.com/in/"), F.lit("")))))
    rows = tables.conversations.join(tables.people.select("ws", "person_id", "name", "profile_url"), ["ws", "person_id"]).drop("person_id", "title").withColumns({
        "counterpart_url": F.when((c("conversation_id") % 2 == 0) & (c("conversation_id") % 50 != 2), c("profile_url")),
        "counterpart_name": F.when(c("conversation_id") % 3 != 0, F.upper("name"))})
    return identity.resolve_counterparts(rows, people).select("ws", "conversation_id", "person_id")


# --- merges and maintenance ------------------------------------------------------------------------------------


@query("dedupe_first", """SELECT l_orderkey, l_returnflag, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS quantity FROM lineitem GROUP BY 1, 2""", base=False)
def _dedupe(tables):
    rows = tables.table("lineitem").withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return dedupe_first(rows.select("l_orderkey", "l_returnflag", F.col("l_quantity").alias("quantity"), "ord"), ["l_orderkey", "l_returnflag"]).drop("ord")


YEARS = """, early AS (SELECT person_id, count(*) AS n, max(ordered_at) AS last_at, min(priority) AS tag, bool_or(order_status = 'F') AS f FROM ords WHERE year(ordered_at) % 2 = 0 GROUP BY 1),
  late AS (SELECT person_id, count(*) AS n, max(ordered_at) AS last_at, CASE WHEN person_id % 3 <> 0 THEN min(priority) END AS tag, bool_or(order_status = 'P') AS f FROM ords WHERE year(ordered_at) % 2 = 1 GROUP BY 1)"""


def halves(tables):
    orders = tables.orders.withColumn("late", F.year("ordered_at") % 2 == 1)
    part = lambda late, status: orders.filter(F.col("late") == late).groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ordered_at").alias("last_at"), F.min("priority").alias("tag"), F.max(F.col("order_status") == status).alias("f"))
    late = part(True, "P").withColumn("tag", F.when(F.col("person_id") % 3 != 0, F.col("tag")))
    return part(False, "F"), late


@query("merge_people", YEARS + """ SELECT coalesce(e.person_id, l.person_id) AS person_id, coalesce(e.n, 0) + coalesce(l.n, 0) AS n, greatest(e.last_at, l.last_at) AS last_at, coalesce(l.tag, e.tag) AS tag,
  coalesce(e.f, false) OR coalesce(l.f, false) AS f, e.person_id IS NULL AS inserted FROM early e FULL JOIN late l USING (person_id)""".replace("coalesce(e.person_id, l.person_id) AS person_id", "person_id"))
def _merge(tables):
    stored, batch = halves(tables)
    return merge.merge_rows(stored, batch, ["person_id"], {"n": merge.SUM, "last_at": merge.LARGEST, "tag": merge.PREFER_NEW, "f": merge.EITHER})


@query("merge_rules", YEARS + """ SELECT person_id, CASE WHEN e.n IS NOT NULL THEN e.n ELSE l.n END AS n, coalesce(e.last_at, l.last_at) AS last_at, CASE WHEN l.n IS NOT NULL THEN l.tag ELSE e.tag END AS tag,
  CASE WHEN e.n IS NOT NULL THEN e.f ELSE l.f END AS f, e.n IS NULL AS inserted FROM early e FULL JOIN late l USING (person_id)""")
def _rules(tables):
    stored, batch = halves(tables)
    return merge.merge_rows(stored, batch, ["person_id"], {"n": merge.KEEP, "last_at": merge.PREFER_OLD, "tag": merge.REPLACE, "f": merge.KEEP})


@query("merge_repeat", """, seen AS (SELECT person_id, order_id, CASE WHEN order_id % 3 <> 0 THEN priority END AS tag, CASE WHEN order_id % 4 <> 1 THEN order_status END AS status FROM ords),
  early AS (SELECT person_id, arg_max(tag, order_id) FILTER (tag IS NOT NULL) AS newest, arg_min(status, order_id) FILTER (status IS NOT NULL) AS oldest, arg_min(order_id, order_id) AS kept, arg_max(order_id, order_id) AS replaced FROM seen WHERE order_id % 2 = 0 GROUP BY 1),
  late AS (SELECT person_id, arg_max(tag, order_id) FILTER (tag IS NOT NULL) AS newest, arg_min(status, order_id) FILTER (status IS NOT NULL) AS oldest, arg_min(order_id, order_id) AS kept, arg_max(order_id, order_id) AS replaced FROM seen WHERE order_id % 2 = 1 GROUP BY 1)
  SELECT person_id, coalesce(l.newest, e.newest) AS newest, coalesce(e.oldest, l.oldest) AS oldest, coalesce(e.kept, l.kept) AS kept, coalesce(l.replaced, e.replaced) AS replaced, e.person_id IS NULL AS inserted FROM early e FULL JOIN late l USING (person_id)""".replace("e.person_id IS NULL", "e.kept IS NULL"))
def _repeat(tables):
    """Even orders are merged into nothing, odd ones into what that left; keys repeat in both, with nulls on either side."""
    c = F.col
    rows = tables.orders.select("person_id", F.when(c("order_id") % 3 != 0, c("priority")).alias("newest"), F.when(c("order_id") % 4 != 1, c("order_status")).alias("oldest"),
                                c("order_id").alias("kept"), c("order_id").alias("replaced"), c("order_id").alias("ord"))
    rules = {"newest": merge.PREFER_NEW, "oldest": merge.PREFER_OLD, "kept": merge.KEEP, "replaced": merge.REPLACE}
    stored = merge.merge_rows(rows.limit(0).drop("ord"), rows.filter("ord % 2 = 0"), ["person_id"], rules).drop("inserted")
    return merge.merge_rows(stored, rows.filter("ord % 2 = 1"), ["person_id"], rules)


@query("import_files", """ SELECT ws, count(*) FILTER (person_id % 11 <> 0) AS accepted, count(*) FILTER (person_id % 11 = 0) AS rejected FROM people GROUP BY ws""")
def _outcomes(tables):
    raw = connection_raw(tables)
    nameless = F.map_filter("row", lambda k, v: ~k.isin("first name", "last name"))
    raw = raw.withColumn("row", F.when(F.col("row_no") % 11 == 0, nameless).otherwise(F.col("row")))
    return run(nz.normalize_connections, raw).outcomes().select("ws", "accepted", "rejected")


@query("tag_dedupe", """SELECT o_custkey AS person_id, lower(tag) AS tag_key, arg_min(tag, o_orderkey) AS tag FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS tag FROM orders) GROUP BY 1, 2""", base=False)
def _tag_dedupe(tables):
    given = F.when(F.col("order_id") % 2 == 0, F.lower("priority")).otherwise(F.col("priority"))
    return mt.dedupe_tags(tables.orders.select(F.lit("w").alias("ws"), "person_id", given.alias("tag"), F.col("order_id").alias("position"))).drop("ws")


@query("tag_replace", """ SELECT ws, person_id, lower(tag) AS tag_key, tag FROM person_tags WHERE person_id % 4 <> 0 UNION ALL SELECT ws, person_id, 'vip', 'VIP' FROM cust WHERE person_id % 4 = 0""")
def _tag_replace(tables):
    assigned = tables.customers.filter("person_id % 4 = 0").select("ws", "person_id", F.posexplode(F.array(F.lit("VIP"), F.lit("vip"))).alias("position", "tag"))
    return mt.replace_tags(tables.person_tags, assigned).select("ws", "person_id", "tag_key", "tag")


@query("orphan_tags", " SELECT ws, tag FROM tags ANTI JOIN person_tags USING (ws, tag)")
def _orphans(tables):
    return mt.orphan_tags(tables.tags, tables.person_tags)


@query("import_rollback", """, gone AS (SELECT ws, person_id FROM people_all WHERE first_import_id = last_import_id) SELECT e.ws, e.employment_id, e.person_id FROM employment_all e ANTI JOIN gone USING (ws, person_id)""")
def _rollback(tables):
    gone = mt.imported_only_by(tables.people, tables.imports.select("ws", "import_id"))
    return mt.without_people(tables.employment, gone).select("ws", "employment_id", "person_id")


@query("snapshot_guard", """, last AS (SELECT ws, max(uploaded_at) AS since FROM imports_all GROUP BY ws), snap AS (SELECT DISTINCT ws, ordered_at AS snapshot_at FROM ords JOIN cust USING (person_id) WHERE person_id % 7 = 0)
  SELECT DISTINCT ws, 'network_report' AS metric_type FROM cust c WHERE NOT EXISTS (SELECT 1 FROM snap s JOIN last l USING (ws) WHERE s.ws = c.ws AND s.snapshot_at >= l.since - INTERVAL 150 DAY - INTERVAL 1 DAY * (length(c.ws) % 3))""")
def _guard(tables):
    shifted = F.col("uploaded_at") - F.expr("INTERVAL '150' DAY") - F.make_dt_interval((F.length("ws") % 3).cast("int"))
    imports = tables.imports.select("ws", shifted.alias("processing_completed_at"))
    taken = tables.orders.filter("person_id % 7 = 0").join(tables.customers.select("ws", "person_id"), "person_id").select(
        "ws", F.col("ordered_at").alias("snapshot_at"), F.lit("network_report").alias("metric_type"))
    wanted = tables.customers.select("ws", F.lit("network_report").alias("metric_type")).distinct()
    return mt.due_snapshots(wanted, taken, imports, "2002-01-01 00:00:00")


@query("segments", """ SELECT ws, lower(name) AS segment_key, arg_min(name, person_id) AS name, arg_max(segment, person_id) AS query, min(person_id) AS first_id FROM
  (SELECT ws, person_id, segment, CASE WHEN person_id % 2 = 0 THEN upper(nation) ELSE nation END AS name FROM cust) GROUP BY 1, 2""")
def _segments(tables):
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'") + F.make_dt_interval(F.col("person_id").cast("int"))
    name = F.when(F.col("person_id") % 2 == 0, F.upper("nation")).otherwise(F.col("nation"))
    rows = tables.customers.select("ws", F.concat(F.lit(" "), name).alias("name"), F.lit(None).cast("string").alias("description"), F.col("segment").alias("query"), at.alias("at"), "person_id")
    key = F.lower(F.trim("name"))
    first = rows.groupBy("ws", key.alias("k")).agg(F.min("person_id").alias("person_id"))
    stored = mt.save_segment(tables.spark.createDataFrame([], "ws string, segment_key string, name string, description string, query string, created_at timestamp_ntz, updated_at timestamp_ntz"),
                             rows.join(first.select("ws", "person_id"), ["ws", "person_id"], "left_semi").drop("person_id"))
    saved = mt.save_segment(stored, rows.drop("person_id"))
    first_id = F.datediff(F.col("created_at"), F.lit("2024-01-01").cast("date")).cast("long")
    return saved.select("ws", "segment_key", "name", "query", first_id.alias("first_id"))


EXPORTED = """SELECT ws, name AS "Name", first_name AS "First Name", last_name AS "Last Name", current_title AS "Title", current_company AS "Company", location AS "Location", industry AS "Industry", email AS "Email",
  profile_url AS "Profile URL", coalesce(strftime(connected_at, '%Y-%m-%d'), '') AS "Connected On", interaction_count::VARCHAR AS "Interactions",
  coalesce((SELECT string_agg(tag, '; ' ORDER BY tag) FROM person_tags t WHERE t.person_id = p.person_id), '') AS "Tags" FROM people p"""


@query("export_connections", f" {EXPORTED}")
def _export(tables):
    from tieline.sources.facts import facts_of

    return exports.guarded(exports.connection_export(facts_of(tables).people, tables.person_tags))


@query("export_companies", """ SELECT ws, '"' || name || '",' || coalesce('"' || industry || '"', '') || ',,"' || connection_count || '","' || current_count || '","' || former_count || '",' AS line FROM company_counts""")
def _export_companies(tables):
    from tieline.operators.rollups import company_totals

    return exports.csv_lines(exports.company_export(company_totals(tables.companies, tables.employment, tables.people)))


# --- the import job ------------------------------------------------------------------------------------------

_IMPORTED = {}
_UPLOADS = {}


def uploads(tables):
    """`derived_files` written once per directory, as an import reads its uploads several times."""
    if tables.warehouse not in _UPLOADS:
        _UPLOADS[tables.warehouse] = written(derived_files(tables), f"{tables.warehouse}/uploads")
    return _UPLOADS[tables.warehouse]


def imported(tables):
    """The warehouse after importing every derived archive, built once per directory."""
    from tieline.plans.import_job import run_import
    from tieline.plans.warehouse import Warehouse

    if tables.warehouse not in _IMPORTED:
        house = Warehouse(tables.spark, f"{tables.warehouse}/imported", buckets=8)
        run_import(house, uploads(tables).withColumn("uploaded_at", F.expr("TIMESTAMP_NTZ'2024-04-01 00:00:00'")), "2024-04-02 00:00:00")
        _IMPORTED[tables.warehouse] = house
    return _IMPORTED[tables.warehouse]


GOOD = "(SELECT *, c_custkey // 50 AS no FROM customer)"


@query("import_run", f"""SELECT 'w' || no AS ws, count(*) AS people, count(*) AS connections, count(DISTINCT (c_mktsegment, c_custkey % 5)) AS companies, 1::BIGINT AS jobs,
  min(c_name[10:]) AS first_person FROM {GOOD} WHERE no % 9 <> 8 GROUP BY no""", base=False)
def _import_run(tables):
    house = imported(tables)
    count = lambda table: house.read(table).groupBy("ws").agg(F.count(F.lit(1)).alias(table))
    first = house.read("people").groupBy("ws").agg(F.min("last_name").alias("first_person"))
    out = count("people").join(first, "ws")
    for table in ("connections", "companies", "jobs"):
        out = out.join(count(table), "ws", "left")
    return out.select("ws", "people", "connections", "companies", "jobs", "first_person")


@query("import_summary", f"""SELECT 'w' || no AS ws, CASE WHEN no % 9 = 8 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN no % 9 = 8 THEN 'MALFORMED_ARCHIVE' END AS error_code,
  CASE WHEN no % 9 = 8 THEN 0 ELSE 10 END::BIGINT AS file_count, CASE WHEN no % 9 = 8 THEN 0 ELSE count(*) + 1 END::BIGINT AS records_discovered,
  CASE WHEN no % 9 = 8 THEN 0 ELSE 3 * count(*) + count(DISTINCT (c_mktsegment, c_custkey % 5)) + 1 END::BIGINT AS records_imported, 0::BIGINT AS records_rejected FROM {GOOD} GROUP BY no""", base=False)
def _import_summary(tables):
    return imported(tables).read("imports").select("ws", "status", "error_code", "file_count", "records_discovered", "records_imported", "records_rejected")


@query("import_seen_before", f"""SELECT 'w' || no AS ws, CASE WHEN no % 9 <> 8 THEN '{IMPORT}' END AS previous_import FROM {GOOD} GROUP BY no""", base=False)
def _seen_before(tables):
    """The same uploads again, asked for before anything of them is unpacked."""
    named = uploads(tables).withColumn("filename", F.element_at(F.split("archive", "/"), -1))
    return archive.seen_before(archive.upload_checksums(named), imported(tables).read("imports")).select("ws", "previous_import")


KNOWN = {"Connections.csv": "connections", "Saved Jobs.csv": "saved_jobs"}
LISTED = ", ".join(f"({b.lit(n)}, {b.lit(KNOWN.get(n))})" for n in (e.rsplit("/", 1)[-1] for e in ENTRY_NAMES))


@query("import_detail", f"""SELECT 'w' || no AS ws, CASE WHEN no % 9 = 8 THEN 'failed' ELSE 'completed' END AS status, position, filename, dataset, CASE WHEN filename IS NOT NULL THEN if(dataset IS NULL, 'skipped', 'normalized') END AS file_status
  FROM (SELECT DISTINCT no FROM {GOOD}) LEFT JOIN (SELECT row_number() OVER (ORDER BY dataset IS NULL, dataset, filename) AS position, * FROM (VALUES {LISTED}) v(filename, dataset)) f ON no % 9 <> 8""", base=False)
def _detail(tables):
    from tieline.operators.dashboard import import_detail

    house = imported(tables).pinned()
    return import_detail(house.read("imports"), house.read("import_files")).select("ws", "status", "position", "filename", "dataset", "file_status")
