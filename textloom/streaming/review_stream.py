"""The review queue as a stream, and event windows (extensions: the reference polls a queue)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_actions(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(actions: DataFrame, at: str = "created_at", late: str = "10 minutes", key: str = "client_action_id") -> DataFrame:
    """Each action once, whatever its repeats within the watermark."""
    return actions.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def apply_batches(actions: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch to an idempotent ``apply(batch, epoch)``."""
    return actions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, at: str, width: str, by: str) -> DataFrame:
    return events.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, by: str) -> DataFrame:
    return events.groupBy(by, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts")).drop("s")
