"""Plans that must hold at scale: pushed filters, pruned columns, no nested loops, partial aggregates."""

from pyspark.sql import functions as F

from lattica.operators import joins, rows
from lattica.session import table

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_is_one_window_and_no_join(spark):
    e = table(spark, DIR, "events")
    p = plan(joins.asof_join(e.select("event_id", "user_id", "ts"), e.select("user_id", "ts", F.col("event_id").alias("v")), ["user_id"], "ts", "ts", ["v"]))
    assert "Join" not in p and p.count("Window ") == 1


def test_any_join_cuts_the_right_side_on_the_map_side(spark):
    o = table(spark, DIR, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    p = plan(joins.any_join(table(spark, DIR, "customer").select("c_custkey"), o, ["c_custkey"], [F.col("o_orderkey")]))
    assert "partial_min_by" in p and "NestedLoop" not in p and "Cartesian" not in p


def test_range_join_meets_in_buckets(spark):
    bands = spark.createDataFrame([(0, 10, "x")], "lo int, hi int, band string")
    p = plan(joins.range_join(table(spark, DIR, "supplier"), bands, "s_acctbal", "lo", "hi", 5.0))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_final_is_a_partial_aggregate(spark):
    p = plan(rows.final_rows(table(spark, DIR, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]))
    assert "partial_max_by" in p and "Window" not in p


def test_limit_by_cuts_groups_before_the_shuffle(spark):
    p = plan(rows.limit_by(table(spark, DIR, "orders"), 2, ["o_custkey"], [F.col("o_orderkey")]))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(table(spark, DIR, "lineitem").filter("l_quantity < 5").select("l_orderkey"))
    assert "LessThan(l_quantity,5.0)" in p and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_row_numbers_need_no_global_window(spark):
    p = plan(joins.numbered(table(spark, DIR, "orders").select("o_orderkey"), ["o_orderkey"], "n"))
    assert p.count("SinglePartition") == 1 and "partial_count" in p  # the ranges' counts alone
