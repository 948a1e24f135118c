"""Queries over the scalar normalisers, fed with text derived from the tables."""

from pyspark.sql import functions as F

from tieline.checks import base_sql as b
from tieline.checks.registry import query
from tieline.functions import dates, text as t
from tieline.functions import fixed_values as fv

JUNK = "chr(8203) || '  ' || chr(160) || replace(text, ' ', ' ' || chr(9) || chr(12288)) || chr(7) || chr(65279) || ' '"
SQUASH = lambda x: f"trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '[\\s\\x{{00A0}}\\x{{3000}}]+', ' ', 'g'))"


@query("fn_clean", f"""SELECT doc_id, sha256({SQUASH(JUNK)}) AS cleaned, CASE doc_id % 5 WHEN 0 THEN NULL ELSE source END AS kept FROM documents""", base=False)
def _clean(tables):
    spaced = F.replace("text", F.lit(" "), F.lit(" \t　"))
    dirty = F.concat(F.lit("​  \u00a0"), spaced, F.lit("\u0007\ufeff "))
    named = F.when(F.col("doc_id") % 5 == 0, F.element_at(F.array(*[F.lit(p.upper() + " ") for p in [*fv.PLACEHOLDERS, ""]]), (F.col("doc_id") % 6 + 1).cast("int"))).otherwise(F.col("source"))
    return tables.table("documents").select("doc_id", F.sha2(t.clean(dirty), 256).alias("cleaned"), t.optional(named).alias("kept"))


@query("fn_comparison_key", f"SELECT doc_id, sha256({b.comparison_key(SQUASH('text'))}) AS key FROM documents", base=False)
def _comparison(tables):
    return tables.table("documents").select("doc_id", F.sha2(t.comparison_key(F.col("text")), 256).alias("key"))


@query("fn_names", "SELECT c_custkey, replace(c_name, '#', ' ') AS full_name, c_name AS only_last, '' AS none FROM customer", base=False)
def _names(tables):
    first, last = F.split("c_name", "#")[0], F.split("c_name", "#")[1]
    return tables.table("customer").select(
        "c_custkey", t.full_name(F.concat(F.lit("  "), first, F.lit(" ")), F.concat(last, F.lit(" , "))).alias("full_name"),
        t.full_name(F.lit(None).cast("string"), F.col("c_name")).alias("only_last"), t.full_name(F.lit(" "), F.lit("")).alias("none"))


URLS = ["https://www.linkedin.com/in/", "http://linkedin.com/in/", "www.linkedin.com/in/", "https://uk.linkedin.com/in/", "linkedin.com/pub/",
        "https://example.com/in/", "https://www.linkedin.com/company/", "https://notlinkedin.com/in/"]


@query("fn_profile_url", f"""SELECT c_custkey, CASE WHEN c_custkey % 8 < 5 THEN 'https://www.linkedin.com/in/customer ' || right(c_name, 9) || '+é' END AS url,
  CASE WHEN c_custkey % 8 < 5 THEN 'customer ' || right(c_name, 9) || '+é' END AS slug FROM customer""", base=False)
def _profile_url(tables):
    from tieline.sources.binding import pick

    raw = F.concat(pick(URLS, F.col("c_custkey") % 8), F.replace("c_name", F.lit("#"), F.lit("%20")), F.lit("+%C3%A9/?trk=contacts"))
    return tables.table("customer").select("c_custkey", t.profile_url(raw).alias("url"), t.profile_slug(raw).alias("slug"))


@query("fn_company_url", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 3 THEN NULL ELSE 'https://www.linkedin.com/company/supplier-' || s_suppkey END AS url FROM supplier""", base=False)
def _company_url(tables):
    from tieline.sources.binding import pick

    kinds = pick(["company/", "school/", "showcase/", "in/"], F.col("s_suppkey") % 4)
    raw = F.concat(F.lit("linkedin.com/"), kinds, F.lit("Supplier-"), F.col("s_suppkey").cast("string"), F.lit("/about"))
    return tables.table("supplier").select("s_suppkey", t.company_url(raw).alias("url"))


@query("fn_contacts", """SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'c' || c_custkey || '@example.com' END AS email,
  CASE WHEN length(c_custkey::VARCHAR) >= 3 THEN '+1' || '41' || c_custkey END AS phone FROM customer""", base=False)
def _contacts(tables):
    key = F.col("c_custkey").cast("string")
    mail = F.when(F.col("c_custkey") % 4 < 2, F.concat(F.lit(" C"), key, F.lit("@Example.COM "))).when(
        F.col("c_custkey") % 4 == 2, F.concat(F.lit("c"), key, F.lit("@example"))).otherwise(F.concat(key, F.lit(" at example.com")))
    return tables.table("customer").select("c_custkey", t.email(mail).alias("email"), t.phone(F.concat(F.lit("+1 (41) "), key, F.lit(" ext."))).alias("phone"))


ENDINGS = ["", " Inc.", ", LLC", " Holdings Group", " Co., Ltd.", " (formerly Widgets)", " K.K.", " Société"]


@query("fn_company_key", f"""WITH x AS (SELECT p_partkey, p_name, {b.array(ENDINGS)}[(p_partkey % 8 + 1)::INT] AS tail FROM part),
  y AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 5 THEN p_name ELSE p_name || tail END AS name FROM x)
  SELECT p_partkey, trim(name) AS name, regexp_replace({b.comparison_key("replace(name, '.', ' ')")}, '{b.SUFFIX_TAIL}', '') AS key FROM y""", base=False)
def _company_key(tables):
    from tieline.sources.binding import pick

    raw = F.concat("p_name", pick(ENDINGS, F.col("p_partkey") % 8))
    return tables.table("part").select("p_partkey", t.company_name(raw).alias("name"), t.company_key(raw).alias("key"))


@query("fn_title_location", """SELECT p_partkey, p_type AS title, p_name || ', ' || p_brand AS location, p_brand AS school FROM part""", base=False)
def _title(tables):
    place = F.concat(F.lit(" "), F.col("p_name"), F.lit(" ,, "), F.col("p_brand"), F.lit(" , "))
    return tables.table("part").select("p_partkey", t.title(F.concat("p_type", F.lit(" – "))).alias("title"), t.location(place).alias("location"),
                                       t.school(F.concat(F.lit("  "), F.col("p_brand"))).alias("school"))


@query("fn_parse_date", """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 5 THEN date_trunc('month', o_orderdate)::TIMESTAMP WHEN 6 THEN date_trunc('year', o_orderdate)::TIMESTAMP
    WHEN 10 THEN NULL WHEN 11 THEN NULL WHEN 1 THEN o_orderdate + INTERVAL '14 hours 22 minutes 1 second' WHEN 7 THEN CASE WHEN day(o_orderdate) > 12 THEN o_orderdate
    ELSE make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) END ELSE o_orderdate END AS parsed FROM orders""", base=False)
def _parse_date(tables):
    at = F.col("o_orderdate")
    shapes = [
        F.date_format(at, "yyyy-MM-dd"), F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(" 14:22:01 UTC")), F.date_format(at, "dd MMM yyyy"), F.date_format(at, "d MMMM yyyy"),
        F.date_format(at, "MMM d, yyyy"), F.date_format(at, "MMM yyyy"), F.date_format(at, "yyyy"), F.date_format(at, "d/M/yyyy"), F.date_format(at, "M/d/yyyy"),
        F.concat(F.unix_seconds(at.cast("timestamp")).cast("string"), F.lit("000")), F.concat(F.date_format(at, "yyyy"), F.lit("-02-31")), F.date_format(at, "M/d/yy"),
    ]
    text = F.element_at(F.array(*shapes), (F.col("o_orderkey") % 12 + 1).cast("int"))
    # Thirteen digits need an instant after 2001-09-09; earlier ones have the ten-digit form or fewer.
    epoch = F.unix_seconds(at.cast("timestamp"))
    text = F.when((F.col("o_orderkey") % 12 == 9) & (epoch < 1_000_000_000), F.date_format(at, "MMMM d yyyy")).when(
        (F.col("o_orderkey") % 12 == 8) & (F.dayofmonth(at) <= 31), F.date_format(at, "M/d/yyyy")).otherwise(text)
    return tables.table("orders").select("o_orderkey", dates.parse_date(text).alias("parsed"))


@query("fn_parse_count", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 2 THEN 0 ELSE (l_quantity::INT * 1000 + 7)::INT END AS n FROM lineitem", base=False)
def _parse_count(tables):
    text = F.concat(F.lit("about "), F.col("l_quantity").cast("int").cast("string"), F.lit(",007 endorsements"))
    text = F.when(F.col("l_linenumber") == 2, F.concat(F.lit("-"), F.col("l_quantity").cast("int").cast("string"))).otherwise(text)
    return tables.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.parse_count(text).alias("n"))


@query("fn_filenames", "SELECT page_id, 'page_' || page_id || ' (1).csv' AS name, left(repeat('x', 250), 196) || '.csv' AS cut FROM pages", base=False)
def _filenames(tables):
    raw = F.concat(F.lit("C:\\temp/../..page*"), F.col("page_id").cast("string"), F.lit(" (1).csv"))
    return tables.table("pages").select("page_id", t.safe_filename(raw).alias("name"), t.safe_filename(F.lit("x" * 250 + ".csv")).alias("cut"))


@query("fn_csv_cell", "SELECT c_custkey, chr(34) || CASE c_custkey % 3 WHEN 0 THEN chr(39) || '=' WHEN 1 THEN chr(39) || '-' ELSE 'a' END || c_custkey || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) AS cell FROM customer", base=False)
def _cell(tables):
    lead = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit("a")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return tables.table("customer").select("c_custkey", t.csv_cell(F.concat(lead, F.col("c_custkey").cast("string"), F.lit('"x"'))).alias("cell"))
