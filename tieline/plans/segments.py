"""Segments of the stored warehouse: save, list, delete, and who is in them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tieline.operators import maintenance as mt, segments as sg
from tieline.plans.warehouse import Warehouse
from tieline.sources.facts import facts_of


def save(warehouse: Warehouse, batch: DataFrame) -> None:
    """Save segments (ws, name, description, query, at), all of a batch or none. A name in other letter case is the same segment."""
    bad = sg.refused(batch).select("name", "reason").first()
    if bad:
        raise ValueError(f"segment {bad['name']!r}: {bad['reason']}")
    workspaces = batch.select("ws").distinct()
    with warehouse.transaction():
        warehouse.put("segments", mt.save_segment(warehouse.of("segments", workspaces), batch), workspaces)


def listed(warehouse: Warehouse) -> DataFrame:
    return warehouse.read("segments").orderBy("ws", "name")


def delete(warehouse: Warehouse, names: DataFrame) -> int:
    """Delete segments (ws, name); returns how many there were."""
    workspaces = names.select("ws").distinct()
    with warehouse.transaction():
        held = warehouse.of("segments", workspaces)
        left = mt.delete_segments(held, names)
        gone = held.count() - left.count()
        warehouse.put("segments", left, workspaces)
    return gone


def members(warehouse: Warehouse, now: str) -> DataFrame:
    """(ws, segment_key, person_id, context_score) of all stored segments."""

    class Stored:
        def __getattr__(self, name):
            return None if name.startswith("fact_") else warehouse.read(name)

    return sg.members(warehouse.read("segments"), facts_of(Stored()), now)
