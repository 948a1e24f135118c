"""Distributions with explicit coverage: counts per key, shares of the known and of the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tieline.functions import classify, metrics as m, text as t

BIN_COLUMNS = [
    "ws", "dimension", "key", "label", "count", "known", "total", "share_of_known", "share_of_network",
    "trust", "confidence", "method", "assumptions",
]


def network_size(people: DataFrame) -> DataFrame:
    return people.groupBy("ws").agg(F.count(F.lit(1)).alias("total"))


def _bins(counts: DataFrame, known: DataFrame, people: DataFrame, dimension: str) -> DataFrame:
    """Attach coverage to per-key counts. `known` is (ws, known); both sides are aggregates."""
    return (
        counts.join(known, "ws").join(network_size(people), "ws")
        .select(
            "ws", F.lit(dimension).alias("dimension"), "key", "label", "count", "known", "total",
            m.percent(F.col("count"), F.col("known")).alias("share_of_known"),
            m.percent(F.col("count"), F.col("total")).alias("share_of_network"),
            "trust", "confidence", "method", "assumptions",
        )
    )


def _known_as_sum(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ws").agg(F.sum("count").alias("known"))


def _provenance(df: DataFrame, trust: str, confidence: str, method: str, assumptions: list[str]) -> DataFrame:
    notes = F.array(*[F.lit(a) for a in assumptions]) if assumptions else F.array().cast("array<string>")
    return (
        df.withColumn("trust", F.lit(trust)).withColumn("confidence", F.lit(confidence))
        .withColumn("method", F.lit(method)).withColumn("assumptions", notes)
    )


def _labels(companies: DataFrame) -> DataFrame:
    return companies.select("ws", F.col("company_key").alias("key"), F.col("name").alias("_company"))


def current_companies(people: DataFrame, companies: DataFrame) -> DataFrame:
    key = t.effective_key(F.col("current_company_key"), F.col("current_company"))
    counts = (
        people.select("ws", "person_id", "current_company", key.alias("key")).filter("key <> ''")
        .groupBy("ws", "key").agg(
            F.count(F.lit(1)).alias("count"), F.min_by("current_company", "person_id").alias("_written")
        )
        .join(_labels(companies), ["ws", "key"], "left")
        .withColumn("label", F.coalesce("_company", "_written", "key"))
    )
    counts = _provenance(
        counts, "observed", "high", "Current employer on the person record, grouped by normalised company key.", []
    )
    return _bins(counts, _known_as_sum(counts), people, "company")


def former_companies(people: DataFrame, employment: DataFrame, companies: DataFrame) -> DataFrame:
    """Distinct people per employer they are no longer at; a person may be in several bins."""
    now = people.select(
        "ws", "person_id",
        t.effective_key(F.col("current_company_key"), F.col("current_company")).alias("_now"),
    )
    left = (
        employment.filter(~F.col("is_current"))
        .select("ws", "person_id", t.effective_key(F.col("company_key"), F.col("company_name")).alias("key"))
        .filter("key <> ''").distinct()
        .join(now, ["ws", "person_id"], "left").filter(~F.col("_now").eqNullSafe(F.col("key")))
    )
    counts = (
        left.groupBy("ws", "key").agg(F.count(F.lit(1)).alias("count"))
        .join(_labels(companies), ["ws", "key"], "left").withColumn("label", F.coalesce("_company", "key"))
    )
    counts = _provenance(
        counts, "derived", "high", "Distinct people with a non-current employment row at this company.",
        ["A Connections.csv snapshot with a later different employer is treated as former."],
    )
    known = left.select("ws", "person_id").distinct().groupBy("ws").agg(F.count(F.lit(1)).alias("known"))
    return _bins(counts, known, people, "former_company")


def _title_counts(people: DataFrame) -> DataFrame:
    """One row per written title, so classifiers run once per distinct title, not per person."""
    return (
        people.filter(F.trim("current_title") != "").groupBy("ws", "current_title")
        .agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("first_id"))
    )


def titles(people: DataFrame) -> DataFrame:
    counts = _title_counts(people).groupBy("ws", t.key_of(F.col("current_title")).alias("key")).agg(
        F.sum("n").alias("count"), F.trim(F.min_by("current_title", "first_id")).alias("label")
    )
    counts = _provenance(
        counts, "observed", "high", "Current job title as exported, grouped case-insensitively.", []
    )
    return _bins(counts, _known_as_sum(counts), people, "title")


def _classified(classed: DataFrame, column: str, assumptions: list[str]) -> DataFrame:
    """Sum pre-counted rows per class; the first person's provenance stands for the bin."""
    notes = F.array(*[F.lit(a) for a in assumptions])
    return (
        classed.filter(F.col(column).isNotNull()).groupBy("ws", F.col(f"{column}.key").alias("key"))
        .agg(F.sum("n").alias("count"), F.min_by(column, "first_id").alias("_first"))
        .select("ws", "key", "count", F.col("_first.label").alias("label"), F.col("_first.trust").alias("trust"),
                F.col("_first.confidence").alias("confidence"), F.col("_first.evidence").alias("method"),
                notes.alias("assumptions"))
    )


def role_families(people: DataFrame) -> DataFrame:
    classed = classify.with_role_family(_title_counts(people), F.col("current_title"))
    counts = _classified(
        classed, "role_class", ["Role families are inferred from title keywords, not LinkedIn’s job taxonomy."]
    )
    return _bins(counts, _known_as_sum(counts), people, "role_family")


def seniority(people: DataFrame) -> DataFrame:
    classed = classify.with_seniority(_title_counts(people), F.col("current_title"))
    counts = _classified(
        classed, "seniority_class",
        ["Seniority is inferred only when the title contains an explicit marker (e.g. Senior, VP)."],
    )
    return _bins(counts, _known_as_sum(counts), people, "seniority")


def industries(people: DataFrame) -> DataFrame:
    distinct = people.groupBy("ws", "industry", "current_title", "current_company").agg(
        F.count(F.lit(1)).alias("n"), F.min("person_id").alias("first_id")
    )
    classed = classify.with_industry(distinct, F.col("industry"), F.col("current_title"), F.col("current_company"))
    counts = _classified(classed, "industry_class", [
        "When LinkedIn did not export industry, it is inferred from title or company keywords.",
        "Inference is not an observed fact.",
    ])
    return _bins(counts, _known_as_sum(counts), people, "industry")


def _location_counts(people: DataFrame) -> DataFrame:
    return people.filter(F.trim("location") != "").groupBy("ws", "location").agg(
        F.count(F.lit(1)).alias("n"), F.min("person_id").alias("first_id")
    )


def locations(people: DataFrame) -> DataFrame:
    counts = _location_counts(people).groupBy("ws", t.key_of(F.col("location")).alias("key")).agg(
        F.sum("n").alias("count"), F.trim(F.min_by("location", "first_id")).alias("label")
    )
    counts = _provenance(
        counts, "observed", "high", "Location string as exported.",
        ["LinkedIn Connections.csv typically has no location column for connections."],
    )
    return _bins(counts, _known_as_sum(counts), people, "location")


def _places(people: DataFrame, grain: str) -> DataFrame:
    parsed = classify.with_geo(_location_counts(people), F.col("location")).withColumn("_place", F.col(f"geo.{grain}"))
    method = F.concat(F.lit("Parsed from location “"), F.col("geo.raw"), F.lit(f"” ({grain})."))
    first = F.struct(F.col("_place").alias("label"), F.col("geo.confidence").alias("confidence"), method.alias("method"))
    counts = (
        parsed.filter(F.col("_place") != "").groupBy("ws", t.key_of(F.col("_place")).alias("key"))
        .agg(F.sum("n").alias("count"), F.min_by(first, "first_id").alias("_first"))
        .select("ws", "key", "count", F.col("_first.label").alias("label"), F.lit("derived").alias("trust"),
                F.col("_first.confidence").alias("confidence"), F.col("_first.method").alias("method"),
                F.array(F.lit("City/country split is heuristic on comma-separated LinkedIn location strings.")).alias("assumptions"))
    )
    return _bins(counts, _known_as_sum(counts), people, grain)


def countries(people: DataFrame) -> DataFrame:
    return _places(people, "country")


def cities(people: DataFrame) -> DataFrame:
    return _places(people, "city")


def schools(people: DataFrame, education: DataFrame) -> DataFrame:
    """Distinct people per school. Known counts people with any school text, even a blank one."""
    attended = education.filter(F.col("school") != "").join(
        people.select("ws", "person_id"), ["ws", "person_id"], "left_semi"
    )
    per_person = (
        attended.filter(F.trim("school") != "").groupBy("ws", t.key_of(F.col("school")).alias("key"), "person_id")
        .agg(F.min("school").alias("_written"))
    )
    counts = per_person.groupBy("ws", "key").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("_written", "person_id").alias("label")
    )
    counts = _provenance(
        counts, "observed", "high", "Distinct people with an education row at this school.",
        ["Most LinkedIn exports only include the archive owner’s Education.csv, not connections’ schools."],
    )
    known = attended.select("ws", "person_id").distinct().groupBy("ws").agg(F.count(F.lit(1)).alias("known"))
    return _bins(counts, known, people, "school")


def underrepresented(bins: DataFrame, min_known: int = 20) -> DataFrame:
    """Bins below half the upper median share, where enough is known and at least three bins exist.

    The median comes from a histogram of equal shares, which stays small however many bins there are."""
    shares = bins.groupBy("ws", "share_of_known").agg(F.count(F.lit(1)).alias("n"))
    ascending = W.partitionBy("ws").orderBy("share_of_known").rowsBetween(W.unboundedPreceding, 0)
    upto = shares.withColumn("upto", F.sum("n").over(ascending))
    size = shares.groupBy("ws").agg(F.sum("n").alias("bins"))
    median = (
        upto.join(size, "ws").filter((F.col("bins") >= 3) & (F.col("upto") > F.floor(F.col("bins") / 2)))
        .groupBy("ws").agg(F.min("share_of_known").alias("median_share"))
    )
    return bins.filter(F.col("known") >= min_known).join(median, "ws").filter(
        F.col("share_of_known") < F.col("median_share") / 2
    )
