"""Session metadata, temporal splits, samples and the history cut."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .running import quantiles, running_sums

TYPES = ("clicks", "carts", "orders")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def sessions_meta(events: DataFrame) -> DataFrame:
    return events.groupBy("session_code").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("n_events"), *(count_if(F.col("etype") == t).alias(f"n_{t}") for t in TYPES))


def temporal_threshold(meta: DataFrame, ratio: float = 0.8) -> DataFrame:
    """One row, one exact quantile of the sessions' starts."""
    return quantiles(meta, [], "min_ts", [ratio]).select(F.col("quantiles")[0].alias("threshold"))


def split_counts(meta: DataFrame, ratio: float = 0.8) -> DataFrame:
    t = F.col("threshold")
    return meta.crossJoin(F.broadcast(temporal_threshold(meta, ratio))).agg(
        count_if(F.col("min_ts") < t).alias("n_train"), count_if(F.col("min_ts") >= t).alias("n_val"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"),
        F.percentile("n_events", 0.5).alias("median_len"), F.max("n_events").alias("max_len"), F.sum("n_events").alias("n_events"),
    )


def side_of(meta: DataFrame, side: str, ratio: float = 0.8) -> DataFrame:
    """Sessions that start before the threshold (`train`) or not (`valid`). The stored threshold is whole milliseconds."""
    t = F.floor("threshold")
    on = F.col("min_ts") < t if side == "train" else F.col("min_ts") >= t
    return meta.crossJoin(F.broadcast(temporal_threshold(meta, ratio))).where(on).drop("threshold")


def temporal_split(rows: DataFrame, ratio: float, time: str, key: str) -> DataFrame:
    """rows with `is_train`: the first floor(n * ratio) in the order of (time, key). No global sort: the cut's time is
    a quantile, and only rows of that very time are ordered."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    if time not in rows.columns:
        raise KeyError(time)
    per_time = rows.groupBy(F.col(time).alias("_time")).agg(F.count("*").alias("_n"))
    if isinstance(rows.schema[time].dataType, NumericType):
        # null times come first
        total = rows.agg(F.floor(F.count("*") * F.lit(ratio)).alias("_take"), (F.count("*") - F.count(time)).alias("_nulls"))
        upto = running_sums(per_time.where("_time IS NOT NULL"), [], "_time", {"_n": "_upto"})
        known = upto.crossJoin(F.broadcast(total)).select("_time", (F.col("_upto") - F.col("_n") + F.col("_nulls")).alias("_before"), "_take")
        places = known.union(per_time.where("_time IS NULL").crossJoin(F.broadcast(total)).select("_time", F.lit(0), "_take"))
    else:
        # times that can't be cut into ranges (texts): their distinct values are ordered in one task
        total = rows.agg(F.floor(F.count("*") * F.lit(ratio)).alias("_take"))
        before = F.sum("_n").over(Window.orderBy("_time")) - F.col("_n")
        places = per_time.select("_time", before.alias("_before")).crossJoin(F.broadcast(total))
    own = F.row_number().over(Window.partitionBy(time).orderBy(key))
    placed = rows.join(places, rows[time].eqNullSafe(places["_time"]))
    return placed.withColumn("is_train", F.col("_before") + own <= F.col("_take")).drop("_time", "_before", "_take")


def sample_sessions(meta: DataFrame, n: int) -> DataFrame:
    """n sessions in the order of the MD5 of their code: the same in any engine. A top-n, not a sort."""
    return meta.orderBy(F.md5(F.col("session_code").cast("string")), "session_code").limit(n)


def history_cut(n_events: Column) -> Column:
    """1-based position of the first event that isn't history: 70 % of the events, half rounded up, at least 1."""
    share = F.round(n_events.cast("decimal(9,1)") * F.lit(Decimal("0.7"))).cast("int")
    return F.greatest(F.lit(1), share)


def with_history(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Events of the sessions of meta with is_hist 0 or 1."""
    cut = meta.select("session_code", history_cut(F.col("n_events")).alias("_cut"))
    return events.join(cut, "session_code").withColumn("is_hist", F.when(F.col("pos") < F.col("_cut"), 1).otherwise(0)).drop("_cut")


def next_item_queries(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Events of the sessions of meta with is_hist (the first 70 % of the events, rounded down, at least 1) and is_target (the event after them)."""
    cut = meta.select("session_code", F.greatest(F.lit(1), F.floor(F.col("n_events") * F.lit(0.7))).alias("_cut"))
    return events.join(cut, "session_code").withColumns({"is_hist": F.col("pos") <= F.col("_cut"), "is_target": F.col("pos") == F.col("_cut") + 1}).drop("_cut")


def graded(etype: Column) -> Column:
    return F.when(etype == "clicks", 1).when(etype == "carts", 2).when(etype == "orders", 3)


def positives(marked: DataFrame) -> DataFrame:
    """session_code, item, label: the strongest action after the cut; null for unknown types alone."""
    return marked.where("is_hist = 0").groupBy("session_code", "item").agg(F.max(graded(F.col("etype"))).alias("label"))


def ground_truth(marked: DataFrame) -> DataFrame:
    return marked.where("is_hist = 0").select("session_code", "item", "etype").distinct()


def history(marked: DataFrame) -> DataFrame:
    return marked.where("is_hist = 1").select("session_code", "item").distinct()


def session_context(events: DataFrame) -> DataFrame:
    """items (first occurrences in order), counts and span of each session. Unknown and missing types count as clicks; n_events counts before items are made distinct."""
    etype = F.when(F.col("etype").isin("carts", "orders"), F.col("etype")).otherwise("clicks")
    rows = events.withColumn("_type", etype)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "item")))
    span = F.when(F.count("ts") >= 2, F.max("ts") - F.min("ts")).otherwise(F.lit(0))
    return rows.groupBy("session_code").agg(F.array_distinct(F.transform(ordered, lambda x: x["item"])).alias("items"), F.count("*").alias("n_events"), *(count_if(F.col("_type") == t).alias(f"n_{t}") for t in TYPES), span.alias("span_ms"))
