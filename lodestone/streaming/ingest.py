"""Files that arrive over time, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.ingest import Warehouse, ingest_texts
from lodestone.sources import readers


def watch_folder(spark: SparkSession, folder: str, warehouse: Warehouse, dataset: str, checkpoint: str, files_per_batch: int = 1000, available_now: bool = True, **options) -> StreamingQuery:
    """Ingests new files of ``folder`` batch by batch.

    A batch that is run again after a failure finds its documents running on
    the same content and only adds what is missing.
    """
    source = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .filter(readers.eligible(F.col("path"), F.col("length")))
    )

    def land(batch, _):
        if not batch.isEmpty():
            ingest_texts(warehouse, readers.read_files(batch.select("path", "content")), dataset, **options)

    writer = source.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def audit_rates(events, timestamp: str = "ts", late: str = "10 minutes", window: str = "5 minutes"):
    """Counts and mean values of request events by type and time window; rows later than ``late`` are dropped."""
    return (
        events.withWatermark(timestamp, late)
        .groupBy(F.window(timestamp, window), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "mean_value")
    )
