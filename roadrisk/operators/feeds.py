"""Partner feeds: uploads, policies, webhooks, request log and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from roadrisk.config import BATCH_TOO_LARGE
from roadrisk.functions import clock, text

UPLOAD_ROW = "array<struct<trip_id:string, speed_mph:double, harsh_braking:int>>"


def check_required(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add the missing fields of each record and the two forms of the error message."""
    return (
        df.withColumn("missing_fields", text.missing_fields(tuple(fields)))
        .withColumn("message", text.missing_fields_message(F.col("missing_fields")))
        .withColumn("first_message", text.first_missing_message(F.col("missing_fields")))
    )


def accepted(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(fields))


def quarantined(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return check_required(df, fields).filter(F.size("missing_fields") > 0)


def upload_rows(uploads: DataFrame, row_type: str = UPLOAD_ROW) -> DataFrame:
    """Records of each upload body, one row per record."""
    return uploads.select(
        "upload_id", "driver_id", F.inline(F.from_json("trip_data", row_type))
    )


def union_trips(*uploads: DataFrame) -> DataFrame:
    """All uploaded trips one after the other; duplicates stay, missing columns become null."""
    result = uploads[0]
    for other in uploads[1:]:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def latest_policies(messages: DataFrame, as_of: str | None = None, keep_days: int = 365) -> DataFrame:
    """Last write per policy number, dropped after a year without one.

    An aggregate, so repeated writes of a policy are combined before the shuffle.
    """
    latest = F.max_by(
        F.struct("message_id", "driver_id", "coverage_details", "partner_name"),
        F.struct("received_at", "message_id"),
    )
    table = (
        messages.groupBy("policy_number")
        .agg(F.max("received_at").alias("sync_timestamp"), latest.alias("_latest"))
        .select("policy_number", "sync_timestamp", "_latest.*", F.lit("synchronized").alias("status"))
    )
    if as_of is None:
        return table
    age = clock.seconds_between(clock.ntz(as_of), F.col("sync_timestamp"))
    return table.filter((age >= 0) & (age < keep_days * clock.SECONDS_PER_DAY))


def webhook_fanout(
    events: DataFrame, subscriptions: DataFrame, as_of: str, keep_days: int = 30
) -> DataFrame:
    """Each event with every active, unexpired subscription that lists its type.

    The subscription side is joined by event type without a hint: below the session's size threshold
    it is broadcast, above it the skewed event types are split by the adaptive skew join.
    """
    age = clock.seconds_between(clock.ntz(as_of), F.col("created_at"))
    live = (
        subscriptions.filter(F.col("is_active") & (age >= 0) & (age < keep_days * clock.SECONDS_PER_DAY))
        .select("webhook_id", "partner_name", F.explode(F.array_distinct("events")).alias("event_type"))
    )
    return events.join(live, "event_type")


def webhook_totals(
    events: DataFrame, subscriptions: DataFrame, as_of: str, keep_days: int = 30
) -> DataFrame:
    """Number, first and last of the events that each subscription gets, by type.

    Events are added up by type before they are fanned out, so that the rows joined are subscriptions and not deliveries,
    whose number is the product of both tables. A subscription that is listed twice gets its events twice.
    """
    per_type = events.groupBy("event_type").agg(
        F.count("*").alias("events"),
        F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
    )
    fanned = webhook_fanout(per_type, subscriptions, as_of, keep_days)
    return fanned.groupBy("event_type", "webhook_id", "partner_name").agg(
        F.sum("events").alias("events"),
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
    )


def usage_stats(log: DataFrame) -> DataFrame:
    """Requests per endpoint, sign-in type, version and partner, with totals per endpoint and overall."""
    keys = ("endpoint", "auth_type", "api_version", "partner_name")
    counted = log.groupBy(*keys).agg(F.count("*").alias("requests"))
    return counted.groupingSets(
        [[F.col(k) for k in keys], [F.col("endpoint")], []], *keys
    ).agg(F.sum("requests").alias("requests"), F.grouping_id().alias("level"))


def usage_tail(log: DataFrame, keep: int = 10_001) -> DataFrame:
    """Newest requests; each task keeps that many at most."""
    return log.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(keep)


def rate_windows(log: DataFrame, window: str, limit: int) -> DataFrame:
    """Requests per client and fixed window, and how many were over the limit."""
    counted = log.groupBy(F.window("timestamp", window).alias("w"), "client_id").agg(
        F.count("*").alias("requests")
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        "client_id",
        "requests",
        F.greatest(F.col("requests") - limit, F.lit(0)).alias("over_limit"),
    )


def batch_counts(items: DataFrame, cap: int = 1000) -> DataFrame:
    """Size of each submitted batch and whether it is too large."""
    return (
        items.groupBy("batch_id")
        .agg(F.count("*").alias("drivers"))
        .withColumn("accepted", F.col("drivers") <= cap)
        .withColumn("processed_count", F.when(F.col("accepted"), F.col("drivers")).otherwise(0))
        .withColumn(
            "error",
            F.when(~F.col("accepted"), text.filled(BATCH_TOO_LARGE, cap=F.lit(cap))),
        )
    )


def split_into_batches(numbered: DataFrame, size: int = 1000) -> DataFrame:
    """Batch number and place of rows that carry ``row_index``."""
    return numbered.withColumn("batch", F.floor(F.col("row_index") / size)).withColumn(
        "place", F.col("row_index") % size
    )


def overview(uploads: DataFrame, priced: DataFrame) -> DataFrame:
    """One row of totals; without data the demo values 10, 50, 850 and 15 stand in.

    Trips count uploads; the risk distribution is that of the priced drivers.
    """
    per_driver = uploads.groupBy("driver_id").agg(F.count("*").alias("uploads"))
    totals = per_driver.agg(
        F.struct(F.count("*").alias("drivers"), F.sum("uploads").alias("trips")).alias("t")
    ).scalar()

    def level(name: str):
        low, high = {"low": (None, 0.3), "medium": (0.3, 0.7), "high": (0.7, None)}[name]
        hit = F.col("risk_score").isNotNull()
        if low is not None:
            hit = hit & (F.col("risk_score") >= low)
        if high is not None:
            hit = hit & (F.col("risk_score") < high)
        return F.count(F.when(hit, 1)).alias(f"{name}_risk")

    return (
        priced.agg(
            F.count("*").alias("_priced"),
            F.avg("final_premium").alias("_average"),
            level("low"),
            level("medium"),
            level("high"),
        )
        .withColumn("_totals", totals)
        .select(
            F.when(F.col("_totals.drivers") > 0, F.col("_totals.drivers")).otherwise(10).alias("total_drivers"),
            F.when(F.col("_totals.drivers") > 0, F.col("_totals.trips")).otherwise(50).alias("total_trips"),
            F.coalesce("_average", F.lit(850.0)).alias("average_premium"),
            "low_risk",
            "medium_risk",
            "high_risk",
            F.when(F.col("_priced") > 0, F.col("_priced")).otherwise(15).alias("active_policies"),
        )
    )
