"""The driver's tables as event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the fixture's event types stand for; others stay as they are.
ETYPES = {"view": "clicks", "click": "carts", "purchase": "orders"}
FLAGS = {"N": "clicks", "R": "carts", "A": "orders"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column, names):
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(column == k, v).otherwise(out)
    return F.coalesce(out, column)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a session per user."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.col("user_id").alias("session_code"), pos.alias("pos"), F.get_json_object("props", "$.k").alias("item"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), _mapped(F.col("event_type"), ETYPES).alias("etype"),
    )


def basket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders: a session per customer, an event per line."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))
    return lines.select(
        F.col("o_custkey").alias("session_code"), pos.alias("pos"), F.col("l_partkey").cast("string").alias("item"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"), _mapped(F.col("l_returnflag"), FLAGS).alias("etype"),
    )
