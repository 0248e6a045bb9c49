"""Progress events: a durable log, throttling, and the fold that a viewer sees, as batch and as stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config, schemas


def append_events(events: DataFrame, path: str) -> None:
    """Publish: append to the log. Readers may start at any time and see everything from the log's start."""
    events.select(*schemas.schema("events").names).write.mode("append").parquet(path)


def event_stream(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """Subscribe: the log as a stream, of one document or all."""
    rows = spark.readStream.schema(schemas.schema("events")).parquet(path)
    return rows if document_id is None else rows.where(F.col("document_id") == document_id)


def reports_progress(page: Column, total: Column, every: int = config.THRESHOLDS["progress_every_pages"]) -> Column:
    """Every so many pages, and the last."""
    return (page % every == 0) | (page == total)


def progress_events(pages: DataFrame, every: int = config.THRESHOLDS["progress_every_pages"]) -> DataFrame:
    """(document_id, event, payload) of pages (document_id, page_number, page_count) done: one every so many, and the last."""
    rows = pages.where(reports_progress(F.col("page_number"), F.col("page_count"), every))
    payload = F.to_json(F.struct(F.col("page_number").alias("pages_done"), F.col("page_count").alias("pages_total")))
    return rows.select("document_id", F.lit(config.EVENTS[0]).alias("event"), payload.alias("payload"))


def poll(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "2 seconds"):
    """A view that asks again every ``interval`` instead of being told: the stream of ``rows`` given to ``sink`` batch by batch."""
    return rows.writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(sink).start()


def percent(done: Column, total: Column) -> Column:
    return F.floor(F.try_divide(done.cast("double"), total) * 100 + 0.5).cast("long")


def stage_rank(event: Column, order=config.EVENTS[:5]) -> Column:
    """The place of an event in the order of stages, null for others."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(order):
        out = F.when(event == name, F.lit(i)).otherwise(out)
    return out


def fold(events: DataFrame, order=config.EVENTS[:5]) -> DataFrame:
    """What is known of each document: events seen, the furthest stage, extracted and verified claims, the last
    event by sequence and whether it has ended. Works on a stream as well (complete or update mode): only mergeable aggregates."""
    furthest = F.max(stage_rank(F.col("event"), order))
    names = F.array(*map(F.lit, order))
    folded = events.groupBy("document_id").agg(
        F.count("*").alias("n_events"),
        furthest.alias("furthest"),
        F.count_if(F.col("event") == order[2]).alias("n_extracted"),
        F.count_if(F.col("event") == order[3]).alias("n_verified"),
        F.max_by("event", "seq").alias("last_event"),
        F.bool_or(F.col("event").isin(order[4], config.EVENTS[5])).alias("ended"),
    )
    return folded.withColumn("stage", F.get(names, F.col("furthest"))).drop("furthest")


def encode(events: DataFrame) -> DataFrame:
    """Events as named JSON messages."""
    return events.select("document_id", "seq", F.col("event").alias("name"), F.to_json(F.struct("document_id", "seq", "event", "payload")).alias("data"))


def windowed_counts(events: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: events by hour and kind with bounded state, for logs with event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event").agg(F.count("*").alias("n"))
