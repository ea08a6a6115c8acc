"""Popularity, the co-visitation graph, candidate pools and the ranking frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sessions import TYPES, count_if, graded, history

DAY_MS = 86_400_000
WINDOWS = (7, 30, 90)
#: The ranker's features, in order.
FEATURES = [
    "clicks_all", "carts_all", "orders_all", "total_all",
    "clicks_30d", "carts_30d", "orders_30d", "total_30d",
    "total_7d", "total_90d",
    "covis_score", "covis_max",
    "n_events", "n_clicks", "n_carts", "n_orders", "span_ms",
    "in_history",
]


def popularity(events: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """item and its counts by type over all time and trailing windows that end at the last event: one pass, partial sums."""
    last = events.agg(F.max("ts").alias("_last"))
    rows = events.crossJoin(F.broadcast(last))
    measures = []
    for name, days in (("all", None), *((f"{d}d", d) for d in windows)):
        recent = F.lit(True) if days is None else F.col("ts") >= F.col("_last") - days * DAY_MS
        measures += [count_if(recent & (F.col("etype") == t)).alias(f"{t}_{name}") for t in TYPES] + [count_if(recent).alias(f"total_{name}")]
    return rows.groupBy("item").agg(*measures)


def popular_pool(pop: DataFrame, per_type: int = 30, window: str = "30d") -> DataFrame:
    """Items among the top of any type: three top-n selections and a union."""
    parts = [pop.orderBy(F.desc(f"{t}_{window}"), "item").limit(per_type).select("item") for t in TYPES]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def covis_pairs(events: DataFrame, max_gap: int = 50, item: str = "item") -> DataFrame:
    """i, j, c: how often j follows i within max_gap positions of a session; i = j counts too.

    Positions are cut into blocks of max_gap, and each event meets its own block and the next: the join key is (session, block), so
    that one long session is spread over many tasks and costs gap times its length, not its square.
    """
    block = F.floor((F.col("pos") - 1) / max_gap).cast("long")
    left = events.select("session_code", F.col("pos").alias("p"), F.col(item).alias("i"), F.explode(F.array(block, block + 1)).alias("block"))
    right = events.select("session_code", F.col("pos").alias("q"), F.col(item).alias("j"), block.alias("block"))
    near = (F.col("q") > F.col("p")) & (F.col("q") - F.col("p") <= max_gap)
    return left.join(right, ["session_code", "block"]).where(near).groupBy("i", "j").agg(F.count("*").alias("c"))


def covis_neighbours(pairs: DataFrame, min_count: int = 2, top_n: int = 100) -> DataFrame:
    """i, j, weight: the strongest top_n followers of each item."""
    best = Window.partitionBy("i").orderBy(F.desc("c"), "j")
    kept = pairs.where(F.col("c") >= min_count).withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= top_n)
    return kept.select("i", "j", F.col("c").cast("double").alias("weight"))


def build_co_visitation(events: DataFrame, min_count: int = 2, top_n: int = 100, max_gap: int = 50) -> DataFrame:
    return covis_neighbours(covis_pairs(events, max_gap), min_count, top_n)


def write_partial_pairs(events: DataFrame, path: str, buckets: int, only: list[int] | None = None, max_gap: int = 50) -> None:
    """Pair counts of each bucket of sessions (of those in `only`, to go on after a stop), a folder each under path. Sums of all buckets are the whole counts."""
    for b in range(buckets) if only is None else only:
        mine = events.where(F.pmod(F.xxhash64("session_code"), F.lit(buckets)) == b)
        covis_pairs(mine, max_gap).write.mode("overwrite").parquet(f"{path}/bucket={b}")


def merge_partial_pairs(spark: SparkSession, path: str, buckets: int, out: str, parts: int = 16, start: int = 0, min_count: int = 2, top_n: int = 100) -> DataFrame:
    """The neighbours from all buckets' counts, merged in `parts` shares of the items from share `start` on, a folder each under out. A missing bucket is an error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    missing = [b for b in range(buckets) if not (p := folder(f"{path}/bucket={b}/_SUCCESS")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    if missing:
        raise FileNotFoundError(f"no pair counts of buckets {missing} in {path}")
    partial = spark.read.parquet(*(f"{path}/bucket={b}" for b in range(buckets)))
    for k in range(start, parts):
        mine = partial.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).groupBy("i", "j").agg(F.sum("c").alias("c"))
        covis_neighbours(mine, min_count, top_n).write.mode("overwrite").parquet(f"{out}/part={k}")
    return spark.read.parquet(*(f"{out}/part={k}" for k in range(parts)))


def covis_scores(hist: DataFrame, neighbours: DataFrame, top_n: int = 100) -> DataFrame:
    """session_code, item, covis_score, covis_max: one step from distinct history items; history stays in."""
    reached = hist.join(neighbours, hist["item"] == neighbours["i"]).groupBy("session_code", F.col("j").alias("item")).agg(F.sum("weight").alias("covis_score"), F.max("weight").alias("covis_max"))
    best = Window.partitionBy("session_code").orderBy(F.desc("covis_score"), "item")
    return reached.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= top_n).drop("_at")


def retrieve(session_items: DataFrame, neighbours: DataFrame, top_n: int = 100) -> DataFrame:
    """session_code, item, score, rank: repeated items of session_items(session_code, item) count repeatedly; history goes before the cut."""
    reached = session_items.join(neighbours, session_items["item"] == neighbours["i"]).groupBy("session_code", F.col("j").alias("item")).agg(F.sum("weight").alias("score"))
    fresh = reached.join(session_items.select("session_code", "item").distinct(), ["session_code", "item"], "left_anti")
    best = Window.partitionBy("session_code").orderBy(F.desc("score"), "item")
    return fresh.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)


def candidate_union(sample: DataFrame, covis: DataFrame, pool: DataFrame) -> DataFrame:
    """session_code, item: co-visited items and the pool for every session. The pool has at most three top lists, a fixed bound, so it is broadcast."""
    everywhere = sample.select("session_code").crossJoin(F.broadcast(pool.select("item")))
    return covis.select("session_code", "item").union(everywhere).distinct()


def candidate_sources(sample: DataFrame, covis: DataFrame, pool: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """session_code, item, source: the first of covisitation, popularity and ann that offers the item."""
    parts = covis.select("session_code", "item", F.lit(1).alias("at")).union(sample.select("session_code").crossJoin(F.broadcast(pool.select("item"))).withColumn("at", F.lit(2)))
    if dense is not None:
        parts = parts.union(dense.select("session_code", "item", F.lit(3).alias("at")))
    names = F.array(F.lit("covisitation"), F.lit("popularity"), F.lit("ann"))
    return parts.groupBy("session_code", "item").agg(F.min("at").alias("at")).select("session_code", "item", F.element_at(names, F.col("at")).alias("source"))


def feature_frame(marked: DataFrame, sample: DataFrame, pop: DataFrame, neighbours: DataFrame, covis_top: int = 100, per_type: int = 30, labelled: bool = True, sources: bool = False) -> DataFrame:
    """The ranking frame of the sessions of sample: candidates, 18 features and, for training, the graded label; with sources, which step offers the item.

    Session features come from the whole session, and positives outside the pool aren't added.
    """
    # a session's history in one place: where the graph is small enough for a broadcast, its scores need no exchange of all that is reached
    covis = covis_scores(history(marked.repartition("session_code")), neighbours, covis_top)
    pool = sample.select("session_code").crossJoin(F.broadcast(popular_pool(pop, per_type).select("item")))
    # what is known of a pair meets by one grouping; an item that is null equals none
    known = F.col("item").isNotNull()
    facts = {"_offered": "int", "covis_score": "double", "covis_max": "double", "_in": "int"} | ({"label": "int"} if labelled else {})

    def part(rows: DataFrame, **values) -> DataFrame:
        return rows.select("session_code", "item", *(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in facts.items()))

    rows = part(covis, _offered=F.lit(2), covis_score=F.when(known, F.col("covis_score")), covis_max=F.when(known, F.col("covis_max"))).union(part(pool, _offered=F.lit(1)))
    rows = rows.union(part(marked.where(known & (F.col("is_hist") == 1)), _in=F.lit(1)))
    if labelled:
        rows = rows.union(part(marked.where(known & (F.col("is_hist") == 0)), label=graded(F.col("etype"))))
    cands = rows.groupBy("session_code", "item").agg(*(F.max(n).alias(n) for n in facts)).where("_offered IS NOT NULL")
    meta = sample.select("session_code", "n_events", "n_clicks", "n_carts", "n_orders", (F.col("max_ts") - F.col("min_ts")).alias("span_ms"))
    rows = cands.join(meta, "session_code").join(pop, "item", "left")
    label = [F.coalesce("label", F.lit(0)).alias("label")] if labelled else []
    source = [F.when(~known, "ranker").when(F.col("_offered") == 2, "covisitation").otherwise("popularity").alias("source")] if sources else []
    filled = [F.coalesce(F.col(f), F.lit(0)).alias(f) for f in FEATURES[:-1]]
    return rows.select("session_code", "item", *label, *filled, F.coalesce("_in", F.lit(0)).alias("in_history"), *source)


def group_sizes(frame: DataFrame) -> DataFrame:
    return frame.groupBy("session_code").agg(F.count("*").alias("n_rows"))


def holdout(frame: DataFrame, modulus: int = 10) -> DataFrame:
    """frame with is_valid: sessions divisible by the modulus; if either side is empty, all train."""
    mine = (F.col("session_code") % modulus == 0).cast("int")
    both = frame.agg((F.min(mine) < F.max(mine)).alias("_both"))
    return frame.crossJoin(F.broadcast(both)).withColumn("is_valid", F.coalesce(F.col("_both"), F.lit(False)) & (mine == 1)).drop("_both")


def rank_popular(sample: DataFrame, pop: DataFrame, hist: DataFrame, k: int = 20) -> DataFrame:
    """etype, session_code, item, rank: the top k of each type for every session, history taken out after the cut."""
    tops = None
    for t in TYPES:
        top = pop.orderBy(F.desc(f"{t}_30d"), "item").limit(k).select(F.lit(t).alias("etype"), "item", F.col(f"{t}_30d").alias("n"))
        tops = top if tops is None else tops.union(top)
    tops = tops.withColumn("place", F.row_number().over(Window.partitionBy("etype").orderBy(F.desc("n"), "item"))).drop("n")
    shown = sample.select("session_code").crossJoin(F.broadcast(tops)).join(hist, ["session_code", "item"], "left_anti")
    again = Window.partitionBy("session_code", "etype").orderBy("place")
    return shown.select("etype", "session_code", "item", F.row_number().over(again).alias("rank"))


def rank_by_score(frame: DataFrame, score: str, hist: DataFrame, k: int = 20, exclude: str = "after", keep: list[str] | None = None) -> DataFrame:
    """session_code, item, rank and columns to keep: by score and item; history goes before or after the cut at k."""
    rows = frame.join(hist, ["session_code", "item"], "left_anti") if exclude == "before" else frame
    best = Window.partitionBy("session_code").orderBy(F.desc(score), "item")
    top = rows.select("session_code", "item", *(keep or []), F.row_number().over(best).alias("place")).where(F.col("place") <= k)
    left = top if exclude == "before" else top.join(hist, ["session_code", "item"], "left_anti")
    return left.select("session_code", "item", F.row_number().over(Window.partitionBy("session_code").orderBy("place")).alias("rank"), *(keep or []))
