"""The Spark session with the settings that results depend on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(name: str = "sessionloom", master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """Time is UTC, plans adapt at run time. On a cluster, leave master, memory and partitions to spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if root := os.environ.get("SESSIONLOOM_SHARED"):
        builder = builder.config("spark.checkpoint.dir", root)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
