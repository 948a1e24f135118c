"""Named queries over the bound tables and the SQL they are compared with."""

import importlib

MODULES = ["composition", "careers", "people", "services", "report", "text", "ingest"]


def load():
    for module in MODULES:
        importlib.import_module(f"tieline.checks.{module}")
    return importlib.import_module("tieline.checks.registry")
