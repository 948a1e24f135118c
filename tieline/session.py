"""Session helpers. Cluster settings always win over the defaults given here."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Generated methods beyond this size are never compiled by the JVM, only interpreted; operators then run without whole-stage code instead.
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    # Ranks up to this bound are cut before the shuffle; profile lists need 2,700.
    "spark.sql.optimizer.windowGroupLimitThreshold": "3000",
    METHOD_LIMIT: METHOD_BYTES,
    # One archive can inflate to more than a gigabyte, so Arrow batches must not hold many.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = "*", app: str = "tieline", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = dict(LOCAL_DEFAULTS)
    settings["spark.sql.shuffle.partitions"] = "8"
    settings["spark.driver.memory"] = "8g"
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compiled_methods(spark: SparkSession) -> None:
    """Long normalisers run as compiled code, unless the cluster sets a limit of its own."""
    if not spark.sparkContext.getConf().contains(METHOD_LIMIT):
        spark.conf.set(METHOD_LIMIT, METHOD_BYTES)


@lru_cache
def _scratch(application: str) -> str:
    return tempfile.mkdtemp(prefix="tieline-checkpoint-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one only where none is named and everything runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _scratch(context.applicationId)


def run_together(spark: SparkSession, *actions: Callable[[], object], at_once: int = 8) -> list:
    """Submit independent Spark jobs from several threads, so small ones share the cluster's slots."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(a)) for a in actions]]
