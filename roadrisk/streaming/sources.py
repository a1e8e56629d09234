"""Event streams from files and from Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from roadrisk import schemas


def file_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType = schemas.EVENTS,
    pattern: str | None = "*.parquet",
    files_per_trigger: int | None = None,
    bytes_per_trigger: int = 1 << 30,
) -> DataFrame:
    """Parquet files of a folder as they arrive, oldest first. The path may be a glob.

    Every micro-batch is bounded, by bytes or by a number of files, and with it the rows of one driver
    that a stateful job sorts in one task.
    """
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(folder)


def kafka_stream(
    spark: SparkSession, servers: str, topic: str = "telematics-events", max_offsets: int = 5_000_000
) -> DataFrame:
    """Envelopes from a topic keyed by driver; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def with_event_time(events: DataFrame, column: str = "timestamp") -> DataFrame:
    """Zone-free times as instants, which watermarks need; the session time zone must be UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def without_repeats(events: DataFrame, key: str = "event_id", delay: str | None = None) -> DataFrame:
    """Drop events delivered again.

    Without a delay every key is remembered and no distinct event is lost. With one, keys are forgotten after it,
    and events that come later than the delay are dropped by the watermark.
    """
    if delay is None:
        return with_event_time(events).dropDuplicates([key])
    return with_event_time(events).withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([key])
