"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads), BENCH_QUERIES (names, comma-separated).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from roadrisk.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "agg_driver_features_all", "agg_trip_features", "win_step_distance", "win_count_buckets",
    "win_risk_patterns", "win_rolling_risk", "win_recent_cache", "jn_crime_bbox", "agg_crime_risk",
    "agg_accident_risk", "jn_weather_asof", "fn_combined_context", "prc_batch", "agg_market_position",
    "agg_auc_ovr", "agg_driver_summary", "win_latest_policy", "jn_webhook_fanout", "str_event_risk",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.minPartitionNum", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def laid_out(spark: SparkSession, folder: str, files: int) -> str:
    """The tables of a folder with the events in several files: the given file is one row group, which one task would read."""
    scratch = tempfile.mkdtemp(prefix="bench-")
    for table in Path(folder).resolve().glob("*.parquet"):
        if table.name != "events.parquet":
            (Path(scratch) / table.name).symlink_to(table)
    spark.read.parquet(f"{folder}/events.parquet").repartition(files).write.parquet(f"{scratch}/events.parquet")
    return scratch


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    name_of_scale, folder = Path(folder).name.removeprefix("sf"), laid_out(spark, folder, int(cpus))
    QUERIES["agg_dataset_profile"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    first = {}
    for name in names:
        for record in (first, seconds):  # the second run is reported, the first one compiles
            begin = time.perf_counter()
            QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            record[name] = round(time.perf_counter() - begin, 3)
    points = QUERIES["agg_dataset_profile"].run(spark, folder).first()["total_records"]
    line = {
        "metric": "total seconds of the headline queries, second run of each",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": name_of_scale,
        "cpus": int(cpus),
        "first_run_total": round(sum(first.values()), 3),
        "points": points,
    }
    if seconds.get("agg_driver_features_all"):
        line["points_per_second"] = round(points / seconds["agg_driver_features_all"])
    print(json.dumps(line))


if __name__ == "__main__":
    main()
