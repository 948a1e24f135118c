"""The stored search index of a warehouse. Once built, imports and deletions keep it with the rows they change, in the same version."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tieline.operators import postings as po
from tieline.plans.warehouse import Warehouse
from tieline.sources.facts import LoadedFacts, facts_of


def _put(warehouse: Warehouse, workspaces: DataFrame) -> None:
    rows = [warehouse.of(t, workspaces) for t in ("people", "companies", "conversations", "messages")]
    warehouse.put("postings", po.postings(*rows), workspaces)
    warehouse.put("posting_counts", po.posting_counts(warehouse.of("postings", workspaces)), workspaces)


def build(warehouse: Warehouse) -> None:
    """Index everything stored."""
    with warehouse.transaction():
        _put(warehouse, warehouse.read("people").select("ws").distinct())


def refresh(warehouse: Warehouse, workspaces: DataFrame) -> None:
    """Index the rows of some workspaces anew, where there is an index."""
    if warehouse.exists("postings"):
        with warehouse.transaction():
            _put(warehouse, workspaces)


def search(warehouse: Warehouse, terms: list[str], limit: int = 20) -> DataFrame:
    """Hits of every term in every workspace: (ws, q, position, type, id, title, subtitle, detail, score, total)."""
    if not warehouse.exists("postings"):
        raise ValueError("build the index first")

    class Stored:
        def __getattr__(self, name):
            return None if name.startswith("fact_") else warehouse.read(name)

    tables = Stored()
    facts: LoadedFacts = facts_of(tables)
    return po.search(tables.postings, tables.posting_counts, facts.people, tables.companies, tables.conversations, tables.messages, tables.people, terms, limit)
