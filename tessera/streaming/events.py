"""Streaming forms of the event operators.

Event time and watermarks are choices of this engine: the service that the operators
describe counts by arrival.  Late events within the watermark are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def minute_counts(events: DataFrame, key: str, at: str = "created_at", late: str = "10 minutes") -> DataFrame:
    """Requests of each key in tumbling minutes."""
    out = events.withWatermark(at, late).groupBy(F.window(at, "1 minute"), key).agg(F.count("*").alias("requests"))
    return out.select(key, F.col("window.start").alias("minute"), "requests")


def daily_rollup(events: DataFrame, at: str = "created_at", late: str = "1 day") -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("searches"), F.sum("latency_ms").alias("latency"), F.count_if(F.col("result_count") == 0).alias("zero_results"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "searches", "latency", "zero_results")


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and stops."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def newest(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The last version of a versioned table, or None; with ``below`` the last one before that number."""
    from pyspark.errors import AnalysisException

    try:
        versions = spark.read.parquet(target).select("v").distinct()
    except AnalysisException:
        return None
    last = (versions if below is None else versions.filter(F.col("v") < below)).agg(F.max("v")).first()[0]
    return None if last is None else spark.read.parquet(f"{target}/v={last}")


def table_sink(target: str):
    """A ``foreachBatch`` function for complete results: every batch is a version of the table, written by the executors."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/v={number}")


def upsert_sink(target: str, key: list[str], order: list[str]):
    """A ``foreachBatch`` function that keeps each key's last row in versioned folders under ``target``.

    Batch ``n`` reads the last version before it, whichever that is, and writes version
    ``n``; writing it again after a failure gives the same table.
    """
    from ..operators.jobs import latest_upsert

    def apply(batch: DataFrame, number: int) -> None:
        last = newest(batch.sparkSession, target, number)
        rows = batch if last is None else last.unionByName(batch)
        latest_upsert(rows, key, order).write.mode("overwrite").parquet(f"{target}/v={number}")

    return apply
