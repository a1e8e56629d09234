"""Every registered query: result against its reference SQL in DuckDB, and its physical plan."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from roadrisk.plans.catalog import QUERIES
from tests.conftest import SMALL
from tools.check import TABLES, canonical

RUN_JOBS = ("src_csv", "src_event_stream", "snk_", "str_", "ml_")  # plans over written files or models
SLOW_PARTS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if QUERIES[n].sql])
def test_query_equals_reference(spark, duck, name):
    df = QUERIES[name].run(spark, SMALL)
    if not name.startswith(RUN_JOBS):
        plan = plan_of(df)
        assert not [part for part in SLOW_PARTS if part in plan]
    got, want = df.toPandas(), duck.execute(QUERIES[name].sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_only_model_queries_go_without_reference():
    assert {n for n in QUERIES if not QUERIES[n].sql} == {
        "ml_random_forest", "ml_linear_logistic", "ml_gradient_boosting", "ml_train_all", "ml_compare",
        "ml_importance", "ml_predict_score", "ml_predict_category", "ml_batch_score", "snk_models",
    }


def test_entry_points(spark):
    assert entry.entry(spark).columns[0] == "driver_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_driver_features_need_three_shuffles(spark):
    """Points once, trip rows once, driver rows once, besides the spread of the one small test file."""
    plan = plan_of(QUERIES["agg_driver_features_all"].run(spark, SMALL))
    assert plan.count("Exchange hashpartitioning") == 3
    assert "Join" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(QUERIES["agg_rate_limit"].run(spark, SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_newest_rows_are_limited_before_the_shuffle(spark):
    for name in ("win_recent_cache", "srt_top_incidents"):
        assert "WindowGroupLimit" in plan_of(QUERIES[name].run(spark, SMALL))


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["jn_claims_count"].run(spark, SMALL))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan


def test_without_broadcast_joins_stay_equi_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("jn_crime_bbox", "jn_accidents_on_route", "jn_webhook_fanout", "prc_premium", "win_step_distance"):
            plan = plan_of(QUERIES[name].run(spark, SMALL))
            assert "SortMergeJoin" in plan and "Broadcast" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
