"""Scalar normalisers against small tables of cases."""

import datetime as dt

from pyspark.sql import functions as F

from tieline.functions import classify, dates, similarity as sim, text as t


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn(F.col("x")).alias("y")).collect()[0]["y"]


def many(spark, cases, fn):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", fn(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_clean(spark):
    many(spark, [("  Mara\u0000  \n Quill ", "Mara Quill"), (None, ""), ("Acme​Corp", "AcmeCorp"), ("a 　b", "a b")], t.clean)


def test_placeholders(spark):
    many(spark, [(v, None) for v in ("", "  ", "N/A", "null", "-", "NA", "undefined", None)] + [(" x ", "x")], t.optional)


def test_profile_url(spark):
    want = "https://www.linkedin.com/in/maraquill"
    good = ["https://www.linkedin.com/in/maraquill", "http://linkedin.com/in/MaraQuill/", "www.linkedin.com/in/maraquill?trk=contacts",
            "https://uk.linkedin.com/in/maraquill", "linkedin.com/pub/maraquill"]
    bad = ["https://example.com/in/mara", "https://www.linkedin.com/company/acme", "not a url", "", None, "https://notlinkedin.com/in/x"]
    many(spark, [(g, want) for g in good] + [(b, None) for b in bad], t.profile_url)
    many(spark, [("linkedin.com/in/a%20b+c", "a b+c"), ("linkedin.com/in/%zz", "%zz")], t.profile_slug)


def test_contacts(spark):
    many(spark, [(" Mara.Quill@Example.COM ", "mara.quill@example.com"), ("nope", None), ("a@b", None)], t.email)
    many(spark, [("+1 (415) 555-0101", "+14155550101"), ("12", None)], t.phone)


def test_company_key(spark):
    many(spark, [("Acme Corp", "acme"), ("Acme, Inc.", "acme"), ("ACME", "acme"), ("Acme Corporation", "acme"), ("Group", "group"), (None, ""),
                 ("Acme Holdings Group Inc", "acme"), ("Tokiwa K.K.", "tokiwa k k"), ("Acme (formerly Widgets)", "acme")], t.company_key)


def test_comparison_key(spark):
    many(spark, [("Íñigo Montoya", "inigo montoya"), ("ﬁne ½", "fine 1 2"), ("Straße", "stra e"), ("日本", "")], t.comparison_key)


def test_titles_and_places(spark):
    many(spark, [("Senior Engineer -", "Senior Engineer"), ("Lead |", "Lead"), ("-", None)], t.title)
    many(spark, [(" San Francisco ,  CA ", "San Francisco, CA")], t.location)
    many(spark, [("About 1,250 times", 1250), ("-3", 0), ("", 0), ("99999999999999", 0)], t.parse_count)
    many(spark, [("../../e vil*.csv", "e vil_.csv"), ("...", "unnamed"), ("a" * 300 + ".zip", "a" * 196 + ".zip")], t.safe_filename)
    many(spark, [("=cmd|calc!A1", "\"'=cmd|calc!A1\""), ('say "hi"', '"say ""hi"""'), (None, "")], t.csv_cell)


def test_parse_date(spark):
    d = lambda *a: dt.datetime(*a)
    many(spark, [
        ("2024-03-05", d(2024, 3, 5)), ("2024-03-05 14:22:01 UTC", d(2024, 3, 5, 14, 22, 1)), ("05 Mar 2024", d(2024, 3, 5)), ("5 March 2024", d(2024, 3, 5)),
        ("Mar 5, 2024", d(2024, 3, 5)), ("Mar 2024", d(2024, 3, 1)), ("2024", d(2024, 1, 1)), ("3/5/2024", d(2024, 3, 5)), ("25/12/2024", d(2024, 12, 25)),
        ("1709648521000", d(2024, 3, 5, 14, 22, 1)), ("1709648521", d(2024, 3, 5, 14, 22, 1)),
        ("", None), ("   ", None), ("sometime", None), ("Febtember 2024", None), ("2024-02-31", None), ("2/14/26", None), ("1800", None), ("0050-01-01", None)], dates.parse_date)


def test_classifiers(spark):
    df = spark.createDataFrame([("CFO",), ("COO",), ("Solutions Architect",), ("Product Designer",), ("Engineering Manager",), ("éai expert",), (None,)], "x string")
    rows = classify.with_seniority(classify.with_role_family(df, F.col("x")), F.col("x")).collect()
    assert [r.role_class and r.role_class.key for r in rows] == ["finance", "operations", "customer", "design", None, None, None]
    assert [r.seniority_class and r.seniority_class.key for r in rows] == ["c_level", "c_level", None, None, "manager", None, None]


def test_geo(spark):
    df = spark.createDataFrame([("Paris, France",), ("San Francisco, CA, US",), ("UK",), ("Springfield, Illinois",), ("a, b, c",), (" , ",)], "x string")
    rows = [r.geo for r in classify.with_geo(df, F.col("x")).collect()]
    assert [(g.city, g.region, g.country, g.confidence) if g else None for g in rows] == [
        ("Paris", None, "France", "high"), ("San Francisco", "CA", "United States", "high"), (None, None, "United Kingdom", "high"),
        ("Springfield", "Illinois", None, "low"), ("a", "b", "c", "medium"), None]


def test_similarity(spark):
    assert one(spark, "jane", lambda c: sim.similarity(c, F.lit("jan"))) == 0.5
    assert one(spark, "Mara Quill", lambda c: sim.similarity(c, F.lit("mara qill"))) > sim.SIMILAR_ABOVE
    assert one(spark, None, lambda c: sim.similarity(c, F.lit("x"))) == 0.0
