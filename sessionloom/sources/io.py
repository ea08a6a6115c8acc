"""Tables in and out, and the folder that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only in local mode (tests) a temporary folder stands in for it; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sessionloom-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch(list):
    """Paths that materialise() wrote inside one scratch() block, the last one last."""

    def __init__(self) -> None:
        super().__init__()
        self.kept: list[str] = []

    def keep(self, table: DataFrame) -> None:
        """This table outlives the block."""
        self.remove(table.scratch_path)
        self.kept.append(table.scratch_path)


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the tables that materialise() writes inside, but for kept ones, which pass to the block around it. Blocks of other threads and
    queries know nothing of each other. Tables written outside any block stay: a lazy result may read them."""
    own, outer = Scratch(), _scratch.get()
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        for path in own:
            remove(spark, path)
        if outer is not None:
            outer.extend(own.kept)


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    own = _scratch.get()
    if own is not None:
        own.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes a table of materialise() before its block ends."""
    remove(table.sparkSession, table.scratch_path)
    own = _scratch.get()
    if own is not None and table.scratch_path in own:
        own.remove(table.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_tabular(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """A DataFrame as it is, a path by its suffix: CSV with a header, else Parquet. Anything else: TypeError."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        raise TypeError(f"expected a DataFrame or a path, got {type(source).__name__}")
    return spark.read.csv(source, header=True, inferSchema=True) if source.lower().endswith(".csv") else spark.read.parquet(source)


def write_table(df: DataFrame, path: str, sort_by: str | None = None) -> None:
    """Parquet; with sort_by, ranges of that key in order over files, so that readers skip by it."""
    if sort_by:
        df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    df.write.mode("overwrite").parquet(path)


def read_report(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str)


def flat_metrics(report: dict, prefix: str = "") -> dict[str, float]:
    """Numbers of a nested report under dotted names; @ can't stand in a metric name and becomes _at_."""
    out: dict[str, float] = {}
    for key, value in report.items():
        name = f"{prefix}{key}".replace("@", "_at_")
        if isinstance(value, dict):
            out |= flat_metrics(value, f"{name}.")
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            out[name] = float(value)
    return out


def dense_codes(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`: 1, 2, 3... in the order of columns that are unique together. Ranges are numbered in parallel; only a
    count for each partition is summed up."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "codes")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = counts.select("_part", "_first", before.alias("_before"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_n", "_first", "_before")
