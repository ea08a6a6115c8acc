"""Ranking metrics over long tables: ranked(..., rank, item) against truth(..., item)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sessions import TYPES

#: Weights of the types in the combined recall.
TYPE_WEIGHTS = {"clicks": 0.10, "carts": 0.25, "orders": 0.65}
NAMES = ("recall", "precision", "hit_rate", "mrr", "map", "ndcg")


def session_metrics(ranked: DataFrame, truth: DataFrame, keys: list[str], ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row per group of truth (also those without a ranked item) with recall, precision, hit_rate, mrr, map and ndcg at each k."""
    truth = truth.select(*keys, "item").distinct()
    sizes = truth.groupBy(*keys).agg(F.count("*").alias("n_rel"))
    hits = ranked.where(F.col("rank") <= max(ks)).select(*keys, "rank", "item").join(truth, [*keys, "item"])
    # an item that is listed twice is one hit for recall and two for precision
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    hits = hits.withColumn("nth", own)
    again = F.row_number().over(Window.partitionBy(*keys, "item").orderBy("rank"))
    hits = hits.withColumn("first", (again == 1).cast("int"))
    sums = []
    for k in ks:
        within = lambda x, k=k: F.coalesce(F.sum(F.when(F.col("rank") <= k, x)), F.lit(0.0))
        sums += [
            within(F.col("first")).alias(f"_found_{k}"), within(F.lit(1)).alias(f"_hits_{k}"), F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias(f"_best_{k}"),
            within(F.col("nth") / F.col("rank")).alias(f"_precisions_{k}"), within(1 / F.log2(F.col("rank") + 1)).alias(f"_dcg_{k}"),
        ]
    rows = sizes.join(hits.groupBy(*keys).agg(*sums), keys, "left")
    out = []
    for k in ks:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        most = F.least(F.col("n_rel"), F.lit(k))
        ideal = F.aggregate(F.sequence(F.lit(1), most.cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
        out += [
            zero(F.col(f"_found_{k}") / F.col("n_rel")).alias(f"recall_{k}"), zero(F.col(f"_hits_{k}") / k).alias(f"precision_{k}"), zero((F.col(f"_hits_{k}") > 0).cast("double")).alias(f"hit_rate_{k}"),
            zero(1 / F.col(f"_best_{k}")).alias(f"mrr_{k}"), zero(F.col(f"_precisions_{k}") / most).alias(f"map_{k}"), zero(F.col(f"_dcg_{k}") / ideal).alias(f"ndcg_{k}"),
        ]
    return rows.select(*keys, "n_rel", *out)


def mean_metrics(per_session: DataFrame, by: list[str]) -> DataFrame:
    names = [c for c in per_session.columns if c.rsplit("_", 1)[0] in NAMES]
    return per_session.groupBy(*by).agg(F.count("*").alias("n_sessions"), *(F.avg(c).alias(c) for c in names))


def macro_average(by_type: DataFrame, metric: str, by: list[str] | None = None) -> DataFrame:
    """Mean over the three types; a missing type counts as 0."""
    return by_type.where(F.col("etype").isin(*TYPES)).groupBy(*(by or [])).agg((F.sum(metric) / len(TYPES)).alias(f"macro_{metric}"))


def weighted_recall(by_type: DataFrame, metric: str = "recall_20", by: list[str] | None = None) -> DataFrame:
    weight = F.lit(0.0)
    for t, w in TYPE_WEIGHTS.items():
        weight = F.when(F.col("etype") == t, w).otherwise(weight)
    return by_type.groupBy(*(by or [])).agg(F.sum(weight * F.col(metric)).alias(f"weighted_{metric}"))


def session_outcomes(per_session: DataFrame, sessions: DataFrame, systems: list[str], k: int = 20) -> DataFrame:
    """session_code, n_events and hit / recall for every system and type; 0 where the session has no truth of the type."""
    columns = []
    for s in systems:
        for t in TYPES:
            mine = (F.col("system") == s) & (F.col("etype") == t)
            columns += [F.coalesce(F.max(F.when(mine, F.col(f"hit_rate_{k}"))), F.lit(0)).cast("int").alias(f"hit{k}_{s}_{t}"), F.coalesce(F.max(F.when(mine, F.col(f"recall_{k}"))), F.lit(0.0)).alias(f"recall{k}_{s}_{t}")]
    return sessions.select("session_code", "n_events").join(per_session, "session_code", "left").groupBy("session_code", "n_events").agg(*columns)
