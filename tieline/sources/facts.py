"""The fact tables that analytics read, loaded from warehouse tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window as W, functions as F

from tieline.functions import fixed_values as fv


@dataclass
class NetworkFacts:
    people: DataFrame
    employment: DataFrame
    education: DataFrame
    companies: DataFrame
    imports: DataFrame
    owners: DataFrame


def owner_ids(people: DataFrame) -> DataFrame:
    """At most one owner per workspace."""
    return people.filter("is_self").groupBy("ws").agg(F.min("person_id").alias("person_id"))


def owner_companies(people: DataFrame, employment: DataFrame) -> DataFrame:
    return (
        employment.filter(F.col("company_key").isNotNull())
        .join(owner_ids(people), ["ws", "person_id"], "left_semi").select("ws", "company_key").distinct()
    )


def owner_schools(people: DataFrame, education: DataFrame) -> DataFrame:
    return (
        education.filter(F.col("school").isNotNull())
        .join(owner_ids(people), ["ws", "person_id"], "left_semi")
        .select("ws", F.lower("school").alias("school_key")).distinct()
    )


def owner_context(people: DataFrame, employment: DataFrame, education: DataFrame) -> DataFrame:
    """(ws, person_id, company_keys, schools). The arrays hold one person's distinct employers and schools."""
    companies = owner_companies(people, employment).groupBy("ws").agg(
        F.sort_array(F.collect_list("company_key")).alias("company_keys")
    )
    schools = owner_schools(people, education).groupBy("ws").agg(
        F.sort_array(F.collect_list("school_key")).alias("schools")
    )
    none = F.array().cast("array<string>")
    return (
        owner_ids(people).join(companies, "ws", "left").join(schools, "ws", "left")
        .select("ws", "person_id", F.coalesce("company_keys", none).alias("company_keys"),
                F.coalesce("schools", none).alias("schools"))
    )


def latest_current(employment: DataFrame) -> DataFrame:
    """Each person's current row observed last: (ws, person_id, current_company_key, current_company_id)."""
    rank = F.row_number().over(
        W.partitionBy("ws", "person_id").orderBy(F.col("observed_at").desc_nulls_last(), F.col("employment_id").desc())
    )
    return employment.filter("is_current").withColumn("_rank", rank).filter("_rank = 1").select(
        "ws", "person_id", F.col("company_key").alias("current_company_key"), F.col("company_id").alias("current_company_id")
    )


def fact_people(people: DataFrame, employment: DataFrame) -> DataFrame:
    """Everyone but the owners, with key and id of the current employer."""
    return people.filter(~F.col("is_self")).join(latest_current(employment), ["ws", "person_id"], "left").drop("is_self")


def without_owners(rows: DataFrame, people: DataFrame) -> DataFrame:
    return rows.join(people.filter("is_self").select("ws", "person_id"), ["ws", "person_id"], "left_anti")


def fact_imports(imports: DataFrame, import_files: DataFrame) -> DataFrame:
    """Completed imports, with whether they held a connections file."""
    held = import_files.filter(F.col("dataset") == "connections").select(
        "import_id", F.lit(True).alias("had_connections")
    ).distinct()
    return (
        imports.filter(F.col("status").isin(fv.COMPLETED_STATUSES)).join(held, "import_id", "left")
        .withColumn("had_connections", F.coalesce("had_connections", F.lit(False)))
    )


def fact_owners(people: DataFrame, employment: DataFrame, education: DataFrame) -> DataFrame:
    row = people.filter("is_self").select("ws", "person_id", "name", "headline", "location", "industry", "profile_url")
    return row.join(owner_context(people, employment, education), ["ws", "person_id"])


class LoadedFacts:
    """The facts of any object that has warehouse tables as attributes. Each is planned on first use;
    where the object stores fact tables of its own, they are read instead of joined again."""

    def __init__(self, tables):
        self.tables = tables

    @cached_property
    def people(self) -> DataFrame:
        stored = getattr(self.tables, "fact_people", None)
        return stored if stored is not None else fact_people(self.tables.people, self.tables.employment)

    @cached_property
    def employment(self) -> DataFrame:
        stored = getattr(self.tables, "fact_employment", None)
        return stored if stored is not None else without_owners(self.tables.employment, self.tables.people)

    @cached_property
    def education(self) -> DataFrame:
        return without_owners(self.tables.education.filter(F.col("school").isNotNull()), self.tables.people)

    @cached_property
    def companies(self) -> DataFrame:
        return self.tables.companies

    @cached_property
    def imports(self) -> DataFrame:
        return fact_imports(self.tables.imports, self.tables.import_files)

    @cached_property
    def owners(self) -> DataFrame:
        return fact_owners(self.tables.people, self.tables.employment, self.tables.education)


def facts_of(tables) -> LoadedFacts:
    return LoadedFacts(tables)
