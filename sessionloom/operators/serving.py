"""Recommendations for many sessions at once: retrieval, ranking, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import FEATURES, feature_frame, rank_by_score
from .experiments import hash_bucket
from .ranking import Ranker
from .sessions import history, sessions_meta
from .vectors import IvfIndex, cosine_of_distance, pool_history


class Recommender:
    """Artifacts of the offline steps, applied to event tables of any number of sessions; every given event is history."""

    def __init__(self, pop: DataFrame, neighbours: DataFrame, ranker: Ranker | None = None, index: IvfIndex | None = None) -> None:
        self.pop, self.neighbours, self.ranker, self.index = pop, neighbours, ranker, index

    def _frame(self, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        marked, meta = events.withColumn("is_hist", F.lit(1)), sessions_meta(events)
        frame = feature_frame(marked, meta, self.pop, self.neighbours, labelled=False, sources=True)
        return frame, meta, history(marked)

    def recommend(self, events: DataFrame, k: int = 20) -> DataFrame:
        """session_code, item, rank, source: history goes before the cut."""
        frame, meta, hist = self._frame(events)
        scored = self.ranker.score(frame) if self.ranker else frame.withColumn("score", F.col("covis_score"))
        return rank_by_score(scored, "score", hist, k, exclude="before", keep=["source"])

    def search(self, events: DataFrame, vectors: DataFrame, k: int = 20, nprobe: int = 8) -> DataFrame:
        """query_id (session), item_id, score, rank: the mean of known history vectors against the index, history skipped; unknown histories give none."""
        hist = events.select("session_code", F.col("item").alias("item_id")).distinct()
        found = self.index.search(pool_history(hist, vectors), k, nprobe, skip=hist.withColumnRenamed("session_code", "query_id"))
        return found.select("query_id", "item_id", F.round(cosine_of_distance(F.col("distance")), 6).alias("score"), "rank")

    def explain(self, events: DataFrame, items: DataFrame) -> DataFrame:
        """Contributions for the pairs of items(session_code, item), as they are served: without the graph, so that both covis features are 0, and rounded to 6
        digits. An item that no event names is an error."""
        unknown = items.select("item").distinct().join(self.pop.select("item"), "item", "left_anti").limit(5).collect()
        if unknown:
            raise KeyError(f"unknown items: {[r['item'] for r in unknown]}")
        frame, meta, hist = self._frame(events)
        own = meta.select("session_code", "n_events", "n_clicks", "n_carts", "n_orders", (F.col("max_ts") - F.col("min_ts")).alias("span_ms"))
        rows = items.select("session_code", "item").distinct().join(own, "session_code").join(self.pop, "item").join(hist.withColumn("_in", F.lit(1)), ["session_code", "item"], "left")
        rows = rows.withColumns({"covis_score": F.lit(0.0), "covis_max": F.lit(0.0), "in_history": F.coalesce("_in", F.lit(0))})
        told = self.ranker.explain(rows.select("session_code", "item", *FEATURES))
        return told.select("session_code", "item", F.round("base", 6).alias("base"), F.round("score", 6).alias("score"), F.transform("contributions", lambda c: F.round(c, 6)).alias("contributions"))


def request_digest(events: DataFrame) -> DataFrame:
    """session_code, digest: a cache key over a session's items in order, not over its id."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    return events.groupBy("session_code").agg(F.substring(F.sha2(F.to_json(F.struct(items.alias("h"), F.lit(20).alias("k"))), 256), 1, 32).alias("digest"))


def placeholder(seeds: DataFrame, seed: str, k: int) -> DataFrame:
    """seed, item, score, rank: a made-up list from a linear congruence, for services without artifacts."""
    step: Column = lambda s, _: F.concat(s, F.array((F.element_at(s, -1) * 31 + 17) % 1_000_000))
    cursors = F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), F.array(hash_bucket(F.col(seed), "placeholder", 1_000_000)), step)
    rows = seeds.select(F.col(seed).alias("seed"), F.posexplode(cursors).alias("at", "c"))
    return rows.select("seed", F.format_string("item_%06d", F.col("c") % 500_000).alias("item"), F.round(1 - F.col("at") / (k + 1), 6).alias("score"), (F.col("at") + 1).alias("rank"))
