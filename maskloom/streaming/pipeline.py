"""Documents that arrive in a folder, masked batch by batch with exactly-once effect.

The batch operators run in ``foreachBatch``; a restart repeats a batch under its number, and its
output folder is replaced, so nothing is written twice. Late copies of a document are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from maskloom.plans.masking import process


def arrivals(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 64) -> DataFrame:
    """A file stream of Parquet documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def first_arrivals(stream: DataFrame, key: str = "doc_id", late: str = "1 hour") -> DataFrame:
    """Drops documents seen before, within the watermark."""
    return stream.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", late).dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = process, once: bool = True) -> StreamingQuery:
    """Write ``work`` of each batch to ``out``/batch=<n>; with ``once``, stop when what is there is done."""

    def write(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def windowed_counts(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by tumbling window and type, with late data up to the watermark. Works on streams and on batches."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
