"""Text built from a format with {names} and columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def number(c: Column) -> Column:
    """A number with one decimal at most, without a trailing zero."""
    return F.regexp_replace(F.format_string("%.1f", c.cast("double")), r"\.0$", "")


def fill(template: str, **values: Column) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [
        F.coalesce(values[part].cast("string"), F.lit("null")) if i % 2 else F.lit(part)
        for i, part in enumerate(parts) if i % 2 or part
    ]
    return F.concat(*pieces)


def people_have(n: Column) -> Column:
    return F.when(n == 1, "person has").otherwise("people have")


def plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")
