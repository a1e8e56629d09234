"""Sinks and whole streaming jobs.

Every sink writes a micro-batch under its own number and replaces it when the batch is run again, so
a restart neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from roadrisk import schemas
from roadrisk.functions import clock
from roadrisk.operators import realtime, trips
from roadrisk.sources.keyed import BUCKETS, KeyedTable, by_hash, children, exists
from roadrisk.sources.lake import PARTITIONS, with_partitions
from roadrisk.streaming.history import with_full_buckets

BATCH = "batch"


def to_files(
    stream: DataFrame, folder: str, checkpoint: str, partitions: Sequence[str] = (), available_now: bool = True
) -> StreamingQuery:
    """Append to Parquet files with the exactly-once file sink."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(folder)


def per_batch(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    make: Callable[[DataFrame], DataFrame] = lambda df: df,
    mode: str = "append",
    available_now: bool = True,
    partitions: Sequence[str] = (),
) -> StreamingQuery:
    """Run a table operator on every micro-batch and write its result under the batch number."""

    def write(df: DataFrame, number: int) -> None:
        make(df).write.mode("overwrite").partitionBy(*partitions).parquet(f"{folder}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)


def newest_per_key(batches: DataFrame, keys: Sequence[str], order: Sequence[str] = (BATCH,)) -> DataFrame:
    """The last written row of each key, as an aggregate."""
    rest = [c for c in batches.columns if c not in keys and c != BATCH]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return batches.groupBy(*keys).agg(latest).select(*keys, "_row.*")


def land_events(
    events: DataFrame, folder: str, checkpoint: str, ingested_at: Column | None = None
) -> StreamingQuery:
    """Raw events by day of ingestion (not of the event)."""
    stamp = F.current_timestamp() if ingested_at is None else ingested_at
    stamped = events.withColumn("ingestion_timestamp", stamp)
    return to_files(with_partitions(stamped, F.col("ingestion_timestamp")), folder, checkpoint, PARTITIONS)


def publish_alerts(scored: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Alert records as key and JSON text; the same columns go to a topic with the Kafka sink."""
    return to_files(alert_messages(scored), folder, checkpoint)


def alert_messages(scored: DataFrame, *also: str) -> DataFrame:
    alerts = realtime.alerts(scored)
    return alerts.select(*also, F.col("driver_id").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def topic_frame(outbox: DataFrame) -> DataFrame:
    """Outbox rows as a topic takes them; the header names the message, so that a reader can tell a repeat."""
    name = F.concat_ws(":", F.col(BATCH).cast("string"), F.col("event_id").cast("string")).cast("binary")
    return outbox.select("key", "value", F.array(F.struct(F.lit("message-id").alias("key"), name.alias("value"))).alias("headers"))


def topic_options(servers: str, topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "includeHeaders": "true",
        "kafka.acks": "all",
        "kafka.enable.idempotence": "true",
    }


def kafka_sender(servers: str, topic: str) -> Callable[[DataFrame, int], None]:
    """Sends messages to a topic; needs the Kafka connector on the class path."""

    def send(messages: DataFrame, number: int) -> None:
        messages.write.format("kafka").options(**topic_options(servers, topic)).save()

    return send


def publish_to_topic(
    scored: DataFrame, outbox: str, checkpoint: str, send: Callable[[DataFrame, int], None], available_now: bool = True
) -> StreamingQuery:
    """Alerts through an outbox: a micro-batch is written under its number, one row per event, then sent and marked as sent.

    A micro-batch that is run again replaces its own outbox rows and is not sent again once it is marked. Only a failure
    between sending and marking repeats messages, which then carry the same ids.
    """

    def publish(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = alert_messages(df, "event_id").dropDuplicates(["event_id"])
        target, mark = f"{outbox}/messages/{BATCH}={number}", f"{outbox}/sent/{BATCH}={number}"
        rows.write.mode("overwrite").parquet(target)
        if not exists(spark, f"{mark}/_SUCCESS"):
            send(topic_frame(spark.read.schema(rows.schema).parquet(target).withColumn(BATCH, F.lit(number))), number)
            spark.range(1).select(F.lit(number).alias(BATCH)).write.mode("overwrite").parquet(mark)

    return for_each(scored, checkpoint, publish, available_now)


def for_each(stream: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


LATEST = ("driver_id", "trip_id")


def _latest_table(spark: SparkSession, folder: str, buckets: int) -> KeyedTable:
    return KeyedTable(spark, folder, by_hash(LATEST, buckets), realtime.latest_risk)


def store_latest_risk(scored: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge the latest assessment per driver and trip into a keyed table; read with ``latest_risk_table``."""

    def merge(df: DataFrame, number: int) -> None:
        _latest_table(df.sparkSession, folder, buckets).merge(df, number)

    return for_each(scored, checkpoint, merge)


def latest_risk_table(
    spark: SparkSession, folder: str, as_of: str | None = None, ttl_seconds: int = realtime.HOUR, buckets: int = BUCKETS
) -> DataFrame:
    """Latest assessments; with ``as_of`` those still alive then."""
    table = _latest_table(spark, folder, buckets).read(schemas.LATEST_RISK)
    if as_of is None:
        return table
    age = clock.seconds_between(clock.ntz(as_of), F.col("timestamp"))
    return table.filter((age >= 0) & (age < ttl_seconds))


def count_bucket_features(
    points: DataFrame, folder: str, checkpoint: str, size: int = 1000, retry: bool = True
) -> StreamingQuery:
    """One feature row per full run of points of a driver. A run without a valid trip is kept and tried again with every further
    point; without ``retry`` it gives no row."""
    return per_batch(
        with_full_buckets(points, size, retry),
        folder,
        checkpoint,
        lambda full: trips.features_of_all_drivers(full, group=("bucket",)),
    )


def count_requests(
    log: DataFrame, folder: str, checkpoint: str, window: str = "1 hour", limit: int = 1000, delay: str | None = None
) -> StreamingQuery:
    """Requests per client and fixed window. Without a delay every request counts, however late; with one, windows
    are closed after it and later requests are dropped."""
    log = log.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if delay is not None:
        log = log.withWatermark("timestamp", delay)
    counted = (
        log.groupBy(F.window("timestamp", window).alias("w"), "client_id")
        .agg(F.count("*").alias("requests"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            "client_id",
            "requests",
            F.greatest(F.col("requests") - limit, F.lit(0)).alias("over_limit"),
        )
    )
    return per_batch(counted, folder, checkpoint, mode="update")


def _request_table(spark: SparkSession, folder: str, buckets: int) -> KeyedTable:
    """Counts by day and hash of the client: a micro-batch rewrites the days it has requests of."""
    day = F.datediff(F.col("window_start"), F.lit("1970-01-01")).cast("long")
    bucket = day * buckets + by_hash(["client_id"], buckets)
    return KeyedTable(
        spark, folder, F.coalesce(bucket, F.lit(-1)), lambda df: df.groupBy("window_start", "client_id").agg(F.sum("requests").alias("requests"))
    )


def merge_request_counts(
    log: DataFrame, folder: str, checkpoint: str, window: str = "1 hour", buckets: int = 8
) -> StreamingQuery:
    """Requests per client and fixed window, merged into a keyed table. No state is held between micro-batches and no
    request is dropped: a late one is added to the stored count of its window. Read with ``request_counts``."""

    def merge(df: DataFrame, number: int) -> None:
        start = F.window(F.col("timestamp").cast("timestamp_ntz"), window)["start"]
        counted = df.select(start.alias("window_start"), F.col("client_id").cast("long").alias("client_id"), F.lit(1).cast("long").alias("requests"))
        _request_table(df.sparkSession, folder, buckets).merge(counted, number)

    return for_each(log, checkpoint, merge)


def request_counts(spark: SparkSession, folder: str, limit: int = 1000, buckets: int = 8) -> DataFrame:
    counts = _request_table(spark, folder, buckets).read(schemas.REQUEST_COUNTS)
    return counts.withColumn("over_limit", F.greatest(F.col("requests") - limit, F.lit(0)))


def land_once(events: DataFrame, folder: str, checkpoint: str, key: str = "event_id", time: str = "timestamp") -> StreamingQuery:
    """Each event once, however late it is delivered again, by micro-batch and day of the event; read with ``read_landed``.

    A micro-batch is compared with the keys stored for its own days, since an event delivered again has its old time; nothing is
    remembered between micro-batches and nothing is dropped. One that is run again is compared with those before it.
    """

    def land(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates([key]).withColumn("day", F.coalesce(F.to_date(time).cast("string"), F.lit("none"))).persist()
        try:
            days = [r[0] for r in fresh.select("day").distinct().collect()]  # one row per day
            earlier = [f"{folder}/{n}" for n in children(spark, folder) if n.startswith(f"{BATCH}=") and int(n.split("=")[1]) < number]
            stored = [f"{path}/day={day}" for path in earlier for day in days if exists(spark, f"{path}/day={day}")]
            new = fresh
            if stored:
                new = fresh.join(spark.read.schema(df.schema).parquet(*stored).select(key), key, "left_anti").select(*fresh.columns)
            new.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/{BATCH}={number}")
        finally:
            fresh.unpersist()

    return for_each(events, checkpoint, land)


def read_landed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/{BATCH}=*").select(*schema.names)


def rescore_uploads(
    points: DataFrame,
    folder: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Score the drivers of each micro-batch from the points of their newest usable upload.

    ``points`` carry ``upload_id``; ``score`` adds ``risk_score`` to driver features. Only rows of the
    micro-batch are read.
    """

    def latest_scores(df: DataFrame) -> DataFrame:
        features = trips.features_of_all_drivers(df, group=("upload_id",))
        return score(features).groupBy("driver_id").agg(
            F.max_by("risk_score", "upload_id").alias("risk_score"), F.max("upload_id").alias("upload_id")
        )

    return per_batch(points, folder, checkpoint, latest_scores)
