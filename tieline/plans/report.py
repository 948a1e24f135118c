"""The analytics report: every metric table of a network, lazily built from shared intermediates."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Window as W, functions as F

from tieline.operators import changes, concentration as con, distributions as dist, growth, mobility, quality, scoring
from tieline.operators.graph import CAVEAT
from tieline.operators.insights import InsightInput, generate_insights
from tieline.sources.facts import NetworkFacts

LIMITATIONS = [
    CAVEAT, "Connection age is not relationship strength.",
    "Industry and role family are inferred when LinkedIn did not export those fields.",
]
# Rows shown per workspace in the compact report.
SHOWN = {"career_moves": 250, "career_flows": 100, "new_connections": 200, "not_seen_in_latest": 200,
         "company_changes": 200, "title_changes": 200}


class AnalyticsReport:
    """Attributes are DataFrames; nothing runs until one is used. `keep(name, df)` stores a table and returns it as stored; given one, tables
    that several parts of the report start from are computed once."""

    def __init__(self, facts: NetworkFacts, now: str, buckets: list[tuple[str, str, float]] | None = None,
                 keep: Callable[[str, DataFrame], DataFrame] | None = None):
        self.facts, self.now, self.buckets = facts, now, buckets
        self.keep = keep or (lambda name, df: df)

    @cached_property
    def moves(self) -> DataFrame:
        return self.keep("moves", mobility.career_moves(self.facts.people, self.facts.employment))

    @cached_property
    def movers(self) -> DataFrame:
        return mobility.multiple_employers(self.facts.people, self.facts.employment)

    @cached_property
    def companies(self) -> DataFrame:
        return self.keep("companies", dist.current_companies(self.facts.people, self.facts.companies))

    @cached_property
    def industries(self) -> DataFrame:
        return self.keep("industries", dist.industries(self.facts.people))

    @cached_property
    def compositions(self) -> dict[str, DataFrame]:
        f = self.facts
        return {
            "company": self.companies, "former_company": dist.former_companies(f.people, f.employment, f.companies),
            "title": dist.titles(f.people), "role_family": dist.role_families(f.people), "seniority": dist.seniority(f.people),
            "industry": self.industries, "location": dist.locations(f.people), "country": dist.countries(f.people),
            "city": dist.cities(f.people), "school": dist.schools(f.people, f.education),
        }

    @cached_property
    def fields(self) -> DataFrame:
        return quality.field_coverage(self.facts.people)

    @cached_property
    def growth(self) -> DataFrame:
        return growth.growth_summary(self.facts.people, self.now)

    @cached_property
    def import_pair(self) -> DataFrame:
        return changes.import_pair(self.facts.imports)

    @cached_property
    def new(self) -> DataFrame:
        return changes.new_connections(self.facts.people, self.facts.imports)

    @cached_property
    def gone(self) -> DataFrame:
        return changes.not_seen(self.facts.people, self.facts.imports)

    @cached_property
    def insights(self) -> DataFrame:
        return generate_insights(InsightInput(
            people=self.facts.people, companies=self.companies, industries=self.industries,
            company_concentration=con.concentration(self.companies), growth=self.growth, moves=self.moves, movers=self.movers,
            fields=self.fields, new=self.new, gone=self.gone, imports=self.import_pair,
        ), self.now)

    @cached_property
    def summary(self) -> DataFrame:
        """One row per workspace with the headline numbers."""
        counted = lambda df, name: df.groupBy("ws").agg(F.count(F.lit(1)).alias(name))
        c = self.compositions
        bands = con.diversity(c["company"], c["industry"], c["country"], c["location"], c["role_family"])
        wide = bands.groupBy("ws").pivot("dimension", ["companies", "industries", "geography", "roles"]).agg(F.first("diversity_band"))
        out = self.growth.select("ws", F.col("total").alias("network_size"), "last_90_days", "acceleration")
        for part in (wide, counted(self.moves, "moves"), counted(self.movers, "people_with_multiple_employers"),
                     counted(self.new, "new_connections"), counted(self.gone, "not_seen")):
            out = out.join(part, "ws", "left")
        return out.fillna(0, ["moves", "people_with_multiple_employers", "new_connections", "not_seen"])

    @cached_property
    def limitations(self) -> DataFrame:
        """(ws, position, text): what no number of the report should be taken to say; part of every report."""
        return self.growth.select("ws", F.posexplode(F.array(*[F.lit(x) for x in LIMITATIONS])).alias("position", "text"))

    @cached_property
    def owner(self) -> DataFrame:
        """Whose networks the report is about, as the facts hold them."""
        return self.facts.owners

    def tables(self) -> dict[str, DataFrame]:
        """All result tables by name."""
        f, c = self.facts, self.compositions
        measured = {"companies": "company", "industries": "industry", "countries": "country", "role_families": "role_family"}
        out = {f"composition_{name}": bins for name, bins in c.items()}
        out |= {f"concentration_{name}": con.concentration(c[key]) for name, key in measured.items()}
        out |= {
            "summary": self.summary, "quality_fields": self.fields,
            "quality_summary": quality.quality_summary(f.people, f.employment, f.education),
            "growth_summary": self.growth, "growth_series": growth.growth_series(f.people),
            "growth_outliers": growth.unusual_months(f.people), "recency": growth.recency(f.people, self.now, self.buckets),
            "career_moves": self.moves, "career_flows": mobility.career_flows(self.moves), "multi_employer": self.movers,
            "role_transitions": mobility.role_transitions(self.moves),
            "industry_transitions": mobility.industry_transitions(f.people, self.moves),
            "import_pair": self.import_pair, "new_connections": self.new, "not_seen_in_latest": self.gone,
            "company_changes": changes.company_changes(self.moves), "title_changes": changes.title_changes(self.moves),
            "limitations": self.limitations, "owner": self.owner, "insights": self.insights, "reconnection_candidates": scoring.reconnection_candidates(f, self.now),
        }
        return out

    def compact(self, shown: dict[str, int] | None = None) -> dict[str, DataFrame]:
        """As `tables`, with the long lists cut to what a report shows; `shown` overrides the lengths by list."""
        out = self.tables()
        orders = {
            "career_moves": ["person_id", "employment_id"], "career_flows": [F.col("count").desc(), "from_label", "from_key", "to_key"],
            "company_changes": ["person_id", "from", "to"], "title_changes": ["person_id", "from", "to"],
        }
        for name, limit in {**SHOWN, **(shown or {})}.items():
            rank = F.row_number().over(W.partitionBy("ws").orderBy(*orders.get(name, ["person_id"])))
            out[name] = out[name].withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
        return out
