"""Ordered-rule classifiers. Each finds the index of its first matching rule once, then looks
labels up by that index, so a pattern chain is evaluated a single time per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import fixed_values as fv
from tieline.functions.text import ascii_words, nullif_blank, slug

CLASS_TYPE = "struct<key:string,label:string,confidence:string,trust:string,evidence:string>"


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    """0-based index of the first rule whose pattern occurs in `text`, else null."""
    chain = F.when(text.rlike(ascii_words(rules[0][0])), F.lit(0))
    for i, (pattern, _) in enumerate(rules[1:], start=1):
        chain = chain.when(text.rlike(ascii_words(pattern)), F.lit(i))
    return chain


def _key_at(index: Column, rules: list[tuple[str, str]]) -> Column:
    return F.get(F.array(*[F.lit(key) for _, key in rules]), index)


def _pattern_at(index: Column, rules: list[tuple[str, str]]) -> Column:
    return F.get(F.array(*[F.lit(f"/{pattern}/") for pattern, _ in rules]), index)


def _label(key: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), key)


def _classification(key: Column, label: Column, confidence: Column, trust: Column, evidence: Column) -> Column:
    return F.when(
        key.isNotNull(),
        F.struct(
            key.alias("key"), label.alias("label"), confidence.alias("confidence"),
            trust.alias("trust"), evidence.alias("evidence"),
        ),
    )


def observed_industry_key(observed: Column) -> Column:
    low = F.lower(observed)
    tech = F.when(low.rlike(ascii_words(fv.OBSERVED_AI)), F.lit("ai")).otherwise(F.lit("software"))
    other = _key_at(first_match(low, fv.OBSERVED_INDUSTRY_RULES), fv.OBSERVED_INDUSTRY_RULES)
    return F.when(low.rlike(ascii_words(fv.OBSERVED_TECH)), tech).otherwise(other)


def with_industry(df: DataFrame, observed: Column, title: Column, company: Column, out: str = "industry_class") -> DataFrame:
    """Adds a classification struct: the observed field first, then title rules, then company rules."""
    blank = F.lit("")
    staged = (
        df.withColumn("_seen", nullif_blank(F.trim(F.coalesce(observed, blank))))
        .withColumn("_mapped", F.when(F.col("_seen").isNotNull(), observed_industry_key(F.col("_seen"))))
        .withColumn(
            "_by_title",
            F.when(F.col("_seen").isNull(), first_match(F.lower(F.coalesce(title, blank)), fv.TITLE_INDUSTRY_RULES)),
        )
        .withColumn(
            "_by_company",
            F.when(
                F.col("_seen").isNull() & F.col("_by_title").isNull(),
                first_match(F.lower(F.coalesce(company, blank)), fv.COMPANY_INDUSTRY_RULES),
            ),
        )
    )
    inferred = F.coalesce(
        _key_at(F.col("_by_title"), fv.TITLE_INDUSTRY_RULES), _key_at(F.col("_by_company"), fv.COMPANY_INDUSTRY_RULES)
    )
    seen = F.col("_seen").isNotNull()
    key = F.when(seen, F.coalesce("_mapped", slug(F.col("_seen")))).otherwise(inferred)
    label = F.when(seen & F.col("_mapped").isNull(), F.col("_seen")).otherwise(
        _label(F.when(seen, F.col("_mapped")).otherwise(inferred), fv.INDUSTRY_LABELS)
    )
    evidence = (
        F.when(seen, F.concat(F.lit("LinkedIn industry field: “"), F.col("_seen"), F.lit("”")))
        .when(
            F.col("_by_title").isNotNull(),
            F.concat(F.lit("Inferred from job title matching "), _pattern_at(F.col("_by_title"), fv.TITLE_INDUSTRY_RULES)),
        )
        .otherwise(
            F.concat(F.lit("Inferred from company name matching "), _pattern_at(F.col("_by_company"), fv.COMPANY_INDUSTRY_RULES))
        )
    )
    built = _classification(
        key, label,
        F.when(seen, F.lit("high")).otherwise(F.lit("medium")),
        F.when(seen, F.lit("observed")).otherwise(F.lit("inferred")),
        evidence,
    )
    return staged.withColumn(out, built).drop("_seen", "_mapped", "_by_title", "_by_company")


def _with_title_class(df: DataFrame, title: Column, rules, labels, confidence, out: str) -> DataFrame:
    trimmed = F.trim(F.coalesce(title, F.lit("")))
    staged = df.withColumn("_rule", F.when(trimmed != "", first_match(F.lower(trimmed), rules)))
    key = _key_at(F.col("_rule"), rules)
    evidence = F.concat(F.lit("Job title “"), trimmed, F.lit("” matched "), _pattern_at(F.col("_rule"), rules))
    built = _classification(key, _label(key, labels), confidence(key), F.lit("inferred"), evidence)
    return staged.withColumn(out, built).drop("_rule")


def with_role_family(df: DataFrame, title: Column, out: str = "role_class") -> DataFrame:
    return _with_title_class(df, title, fv.ROLE_RULES, fv.ROLE_LABELS, lambda k: F.lit("medium"), out)


def with_seniority(df: DataFrame, title: Column, out: str = "seniority_class") -> DataFrame:
    certain = lambda k: F.when(k.isin(fv.SENIORITY_HIGH_CONFIDENCE), F.lit("high")).otherwise(F.lit("medium"))
    return _with_title_class(df, title, fv.SENIORITY_RULES, fv.SENIORITY_LABELS, certain, out)


def with_geo(df: DataFrame, location: Column, out: str = "geo") -> DataFrame:
    """Adds struct(city, region, country, confidence, raw) read from a comma-separated location."""
    raw = F.trim(F.coalesce(location, F.lit("")))
    staged = df.withColumn(
        "_parts", F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")
    ).withColumn("_country", _label(F.lower(F.try_element_at("_parts", F.lit(-1))), fv.COUNTRY_ALIASES))
    n, country = F.size("_parts"), F.col("_country")
    part = lambda i: F.get(F.col("_parts"), i)
    geo = F.struct(
        F.when((n == 1) & country.isNotNull(), F.lit(None)).otherwise(part(0)).alias("city"),
        F.when((n >= 3) | ((n == 2) & country.isNull()), part(1)).alias("region"),
        F.when(n >= 3, F.coalesce(country, part(2))).otherwise(country).alias("country"),
        F.when(country.isNotNull(), F.lit("high")).when(n >= 3, F.lit("medium")).otherwise(F.lit("low")).alias("confidence"),
        raw.alias("raw"),
    )
    return staged.withColumn(out, F.when(n >= 1, geo)).drop("_parts", "_country")
