"""Which dataset a file holds: by name first, else by its header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tieline.functions import fixed_values as fv


def _chain(arms: list[tuple[Column, str]]) -> Column:
    start = F.when(*arms[0])
    return reduce(lambda chain, arm: chain.when(*arm), arms[1:], start)


def dataset_by_name(filename: Column) -> Column:
    return _chain([(filename.rlike(f"(?i){p}"), key) for key, _, _, patterns, _ in fv.DATASETS for p in patterns])


def dataset_by_header(header_keys: Column) -> Column:
    """The longest signature the header holds in full; the first one listed on ties."""
    signatures = [(len(s), key, s) for key, _, _, _, group in fv.DATASETS for s in group]
    signatures.sort(key=lambda x: -x[0])
    holds = lambda s: F.size(F.array_except(F.array(*[F.lit(k) for k in s]), header_keys)) == 0
    return _chain([(holds(s), key) for _, key, s in signatures])


def detect_dataset(filename: Column, header_keys: Column) -> Column:
    return F.coalesce(dataset_by_name(filename), dataset_by_header(header_keys))


def dataset_rank(dataset: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in fv.DATASET_ORDER]), dataset)


def dataset_label(dataset: Column) -> Column:
    return F.create_map(*[F.lit(x) for key, label, *_ in fv.DATASETS for x in (key, label)])[dataset]


def ignored_reason(filename: Column) -> Column:
    return _chain([(filename.rlike(f"(?i){p}"), reason) for p, reason in fv.IGNORED_FILES])


def skip_reason(filename: Column, extension: Column) -> Column:
    """Why a file is not read at all, else null."""
    foreign = F.concat(F.when(extension != "", extension).otherwise("This file type"), F.lit(" is not a LinkedIn data file"))
    return F.coalesce(ignored_reason(filename), F.when(~extension.isin(fv.DATA_EXTENSIONS), foreign))
