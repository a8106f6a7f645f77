"""The plans that the operators are meant to have."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from entitystats.operators import aggregates as A
from entitystats.operators import windows as W
from entitystats.sources.tables import Tables

QUERIES = entry.queries()
SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["lagged_training_rows", "rest_days", "rolling_summary", "decay_weighted_season_mean", "expanding_form", "lag_features", "entity_time_split", "as_of_join", "flat_stake_bets", "season_estimates", "latest_row_per_key"],
)
def test_one_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "SinglePartition" not in text


def test_filters_and_columns_reach_the_scan(spark):
    events = Tables(spark, SF_DIR).events
    text = A.entity_mean_since(events, "user_id", 7, "ts", F.lit("2024-01-10").cast("timestamp_ntz"), "value")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in text and "GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text


def test_latest_rows_are_trimmed_before_the_shuffle(spark):
    text = plan(W.latest_rows(Tables(spark, SF_DIR).events, "user_id", "ts", 3, ["event_id"]))
    assert text.index("WindowGroupLimit") < text.rindex("WindowGroupLimit") and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_cross_products(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs a stream")
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
