"""Imports as archives arrive: a file stream whose batches go through the import job.

Merges are keyed, so late or repeated files are safe and a batch that is retried changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieline.plans.import_job import run_import
from tieline.plans.warehouse import Warehouse, surrogate

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def import_stream(spark: SparkSession, folder: str, warehouse: Warehouse, checkpoint: str, files_per_batch: int = 1000):
    """Start a query over <folder>/<workspace>/<file>; it ends once all present files are merged."""
    arriving = (
        spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        uploads = batch.select(
            F.element_at(F.split("path", "/"), -2).alias("ws"), F.col("path").alias("archive"), "content",
            F.col("modificationTime").cast("timestamp_ntz").alias("uploaded_at"),
        ).withColumn("import_id", surrogate("ws", "archive", F.col("uploaded_at").cast("string")))
        at = batch.sparkSession.sql("SELECT cast(current_timestamp() AS timestamp_ntz) AS t").collect()[0]["t"]
        run_import(warehouse, uploads, str(at))

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
