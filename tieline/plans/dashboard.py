"""Everything the dashboard shows, as tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.operators import dashboard as da, growth, mobility, people as pe, quality, rollups, signals
from tieline.sources.facts import facts_of


def dashboard(tables, now: str) -> dict[str, DataFrame]:
    """`tables` has warehouse tables as attributes. Nothing runs until a table is used."""
    facts = facts_of(tables)
    counted = rollups.company_totals(
        tables.companies.drop("connection_count", "current_count", "former_count"), tables.employment, tables.people)
    moved = mobility.moved_latest(facts.people, facts.employment)
    flagged = signals.with_signals(facts.people, tables.employment, tables.education, tables.people, now)
    top = lambda column: pe.top_per_workspace(pe.value_counts(facts.people, column), 10)
    return {
        "totals": da.dashboard_totals(tables.people, counted, tables.messages, tables.conversations, tables.education, tables.imports),
        "owner": tables.people.filter("is_self").select("ws", "name", "headline", "location", "industry", "profile_url"),
        "growth": growth.growth_observed_months(facts.people), "top_companies": da.top_companies(counted),
        "top_titles": top("current_title"), "top_locations": top("location"), "top_industries": top("industry"),
        "top_schools": pe.top_per_workspace(pe.school_counts(facts.education), 10),
        "signals": signals.signal_counts(flagged), "recent_connections": da.recent_connections(facts.people),
        "career_moves": da.recent_moves(moved), "career_move_count": moved.groupBy("ws").agg(F.count(F.lit(1)).alias("count")),
        "data_quality": quality.field_counts(facts.people),
    }
