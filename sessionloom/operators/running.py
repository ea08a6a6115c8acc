"""Running sums in the order of a number, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import materialise


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """df with sums[name] -> running total of column name over rows of `keys` up to this value of `order`, which is distinct within keys. Keys are not null.

    Rows are dealt to ranges of (keys, order) of about equal numbers of rows, however their values are spread; totals of ranges are summed up first (a row
    for each range, and for each key within), then rows within a range.
    """
    place = [*keys, order]
    rows = df.repartitionByRange(*place).withColumn("_at", F.spark_partition_id())
    rows = materialise(rows, "ranges")
    totals = rows.groupBy(*keys, "_at").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_at", *(F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums))
    own = Window.partitionBy(*keys, "_at").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(before, [*keys, "_at"])
    return met.select(*df.columns, *((F.col(f"_b_{c}") + F.sum(c).over(own)).alias(name) for c, name in sums.items()))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], name: str = "quantiles") -> DataFrame:
    """keys (not null), name: an array of exact quantiles of `value`, between two neighbours in proportion. Nulls don't count.

    Values are counted and the counts summed up by running_sums(), so no task holds all values of a key. Without keys there is always one row,
    of nulls if there are no values.
    """
    per_value = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    totals = per_value.groupBy(*keys).agg((F.sum("_n") - 1).alias("_last"))
    upto = running_sums(per_value, keys, value, {"_n": "_upto"})
    met = upto.join(totals, keys) if keys else upto.crossJoin(F.broadcast(totals))
    place = [F.col("_last") * F.lit(float(q)) for q in shares]
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col(value))).cast("double")
    ends = [x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"_low_{i}"), at(F.ceil(p)).alias(f"_high_{i}"))]
    found = met.groupBy(*keys).agg(F.max("_last").alias("_last"), *ends)
    between = lambda i, p: (F.ceil(p) - p) * F.col(f"_low_{i}") + (p - F.floor(p)) * F.col(f"_high_{i}")
    exact = [F.when(F.col(f"_low_{i}") == F.col(f"_high_{i}"), F.col(f"_low_{i}")).otherwise(between(i, p)) for i, p in enumerate(place)]
    return found.select(*keys, F.array(*exact).alias(name))
