"""Bouts derived from the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutworks.operators.sequence import with_sequence
from boutworks.runtime import read_table

DRAW_WITHIN = 1.0


def bouts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in time order, paired two by two: seq, league, a, b, outcome, ts, score_a, score_b.

    The higher value wins, values less than 1 apart draw, and a pair of the same user is dropped.
    """
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    rows = with_sequence(events, ["ts", "event_id"], "rn").withColumn("who", F.struct("rn", "user_id", "value", "ts"))
    pairs = rows.groupBy(F.expr("rn div 2").alias("seq")).agg(F.min("who").alias("x"), F.max("who").alias("y"), F.count("*").alias("n")).where("n = 2")
    apart = F.col("x.value") - F.col("y.value")
    return pairs.where("x.user_id <> y.user_id").select(
        "seq",
        F.lit("all").alias("league"),
        F.col("x.user_id").cast("string").alias("a"),
        F.col("y.user_id").cast("string").alias("b"),
        F.when(F.abs(apart) < DRAW_WITHIN, 0.5).when(apart > 0, 1.0).otherwise(0.0).alias("outcome"),
        F.col("x.ts").alias("ts"),
        F.col("x.value").alias("score_a"),
        F.col("y.value").alias("score_b"),
    )


def bouts_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring suppliers of an order: the one with more revenue wins; the league is the order's priority."""
    revenue = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    order = Window.partitionBy("l_orderkey").orderBy("l_suppkey")  # an order has a handful of lines
    beside = revenue.withColumns({"b": F.lead("l_suppkey").over(order), "score_b": F.lead("revenue").over(order)}).where("b is not null")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    apart = F.col("revenue") - F.col("score_b")
    return beside.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("o_orderpriority").alias("league"),
        F.col("l_suppkey").cast("string").alias("a"),
        F.col("b").cast("string").alias("b"),
        F.when(apart == 0, 0.5).when(apart > 0, 1.0).otherwise(0.0).alias("outcome"),
        F.col("o_orderdate").alias("ts"),
        F.col("revenue").alias("score_a"),
        "score_b",
    )


def bouts_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's suppliers at odd places against those at even ones: order_key, league, team_a, team_b, outcome, ts.

    The side with more revenue a supplier wins, and less than a tenth of both apart is a draw.
    """
    revenue = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    order = Window.partitionBy("l_orderkey").orderBy("l_suppkey")  # an order has a handful of lines
    placed = revenue.withColumn("odd", F.row_number().over(order) % 2 == 1)
    side = lambda odd: F.when(F.col("odd") == odd, F.col("l_suppkey").cast("string"))
    sums = placed.groupBy("l_orderkey").agg(F.collect_list(side(True)).alias("team_a"), F.collect_list(side(False)).alias("team_b"), F.avg(F.when(F.col("odd"), F.col("revenue"))).alias("x"), F.avg(F.when(~F.col("odd"), F.col("revenue"))).alias("y"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    outcome = F.when(F.abs(F.col("x") - F.col("y")) <= 0.1 * (F.col("x") + F.col("y")), 0.5).when(F.col("x") > F.col("y"), 1.0).otherwise(0.0)
    return sums.where(F.size("team_b") > 0).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("order_key"), F.col("o_orderpriority").alias("league"), "team_a", "team_b", outcome.alias("outcome"), F.col("o_orderdate").alias("ts"))
