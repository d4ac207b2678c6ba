"""Structured Streaming: events are deduplicated, narrowed to scopes and reconciled per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = ("event_id long, company_id string, kind string, dedupe_key string, created_at timestamp, "
                "available_at timestamp, employee_id long, category_id string, changed_fields array<string>")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An append-only folder of JSON events as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed it."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["company_id", "dedupe_key"])


def scopes_of(batch: DataFrame) -> DataFrame:
    return batch.where("employee_id IS NOT NULL").select("employee_id", "category_id").distinct()


def reconcile_stream(events: DataFrame, checkpoint: str, reconcile: Callable[[DataFrame, int], None], available_now: bool = True):
    """Run `reconcile(scopes, batch_id)` once per micro-batch.

    There is a single writer; a batch that is replayed after a failure gets the
    same id, and reconciliation of the same inputs is a no-op.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        reconcile(scopes_of(batch), batch_id)

    writer = deduplicated(events).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def events_per_window(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts of events by kind and window of creation, late events included up to the delay."""
    return events.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "kind").agg(F.count("*").alias("n"))
