"""Vectors: exact and inverted-file search, pooling, towers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def cosine_of_distance(squared: Column) -> Column:
    return 1 - squared / 2


#: Queries that are broadcast at once: 32 MB at 1,024 dimensions.
BLOCK = 4096


def exact_topk(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, item_id, score, rank by cosine for a stated query set(query_id, vec) against all items(item_id, vec).

    Queries are counted and broadcast in blocks of about `block`, one pass over the items each; every task keeps its own best
    k before the exchange.
    """
    q = queries.select("query_id", normalised(F.col("vec")).alias("q"))
    blocks = max(1, -(-queries.count() // block))
    unit = items.select("item_id", normalised(F.col("vec")).alias("v"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item_id")

    def search(part: DataFrame) -> DataFrame:
        scored = unit.crossJoin(F.broadcast(part)).select("query_id", "item_id", dot(F.col("q"), F.col("v")).alias("score"))
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = search(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == 0) if blocks > 1 else q)
    for b in range(1, blocks):
        found = found.unionByName(search(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)))
    return found


def mean_pool(rows: DataFrame, group: str) -> DataFrame:
    """group, dim, mean of rows(group, vec)."""
    return rows.select(group, F.posexplode("vec").alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


class IvfIndex:
    """Cells of a k-means partition. Up to max(nlist, 39) vectors, the search is exact."""

    def __init__(self, items: DataFrame, nlist: int, seed: int = 7, sample: int = 50_000) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.items, self.nlist = items.select("item_id", normalised(F.col("vec")).alias("vec")), nlist
        self.exact = len(items.limit(max(nlist, 39) + 1).select("item_id").collect()) <= max(nlist, 39)
        if self.exact:
            return
        rows = self.items.select("item_id", "vec", array_to_vector("vec").alias("features"))
        # centroids are fitted on a bounded sample; every item is indexed
        self.model = KMeans(k=nlist, seed=seed, maxIter=15).fit(rows.orderBy(F.xxhash64("item_id"), "item_id").limit(sample))
        self.cells = self.model.transform(rows).select("item_id", "vec", F.col("prediction").alias("cell"))
        spark = items.sparkSession
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(self.model.clusterCenters())]
        self.centres = spark.createDataFrame(centres, "cell int, centre array<double>")

    def save(self, path: str) -> None:
        """The index as tables under path, for load()."""
        spark = self.items.sparkSession
        spark.createDataFrame([(self.nlist, self.exact)], "nlist int, exact boolean").write.mode("overwrite").parquet(f"{path}/about")
        if self.exact:
            self.items.write.mode("overwrite").parquet(f"{path}/items")
        else:
            self.cells.repartition("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/cells")
            self.centres.write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IvfIndex:
        index = cls.__new__(cls)
        index.nlist, index.exact = spark.read.parquet(f"{path}/about").first()
        if index.exact:
            index.items = spark.read.parquet(f"{path}/items")
        else:
            index.cells, index.centres = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/centres")
            index.items = index.cells.select("item_id", "vec")
        return index

    def search(self, queries: DataFrame, k: int, nprobe: int, skip: DataFrame | None = None) -> DataFrame:
        """query_id, item_id, distance (squared), rank. Pairs of skip(query_id, item_id) are left out before the cut."""
        q = queries.select("query_id", normalised(F.col("vec")).alias("q"))
        if self.exact:
            met = q.crossJoin(F.broadcast(self.items))  # at most max(nlist, 39) vectors
        else:
            near = q.crossJoin(F.broadcast(self.centres)).withColumn("_d", -dot(F.col("q"), F.col("centre")) * 2 + dot(F.col("centre"), F.col("centre")))
            probes = near.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy("_d", "cell"))).where(F.col("_at") <= nprobe).select("query_id", "q", "cell")
            met = self.cells.join(probes, "cell")
        scored = met.select("query_id", "item_id", (2 - 2 * dot(F.col("q"), F.col("vec"))).alias("distance"))
        if skip is not None:
            scored = scored.join(skip.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
        best = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "item_id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall_against(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact results that were found."""
    met = exact.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return met.agg((F.count("hit") / F.count("*")).alias("recall"))


def pool_history(hist: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, vec: the mean of the vectors of each session's items in hist(session_code, item_id). Sessions without a known item give none."""
    known = hist.join(vectors, "item_id").select("session_code", F.posexplode("vec").alias("dim", "x")).groupBy("session_code", "dim").agg(F.avg("x").alias("x"))
    return known.groupBy(F.col("session_code").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))


def next_item_hits(found: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """One row: n_queries and hit_k, the share of targets(query_id, target) that stand among the first k found. Queries without results miss."""
    met = found.select("query_id", F.col("item_id").alias("target"), "rank")
    rows = targets.join(met, ["query_id", "target"], "left")
    return rows.agg(F.count("*").alias("n_queries"), *(F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"hit_{k}") for k in ks))


def tower(weights: list[tuple[list[list[float]], list[float]]]):
    """A pandas UDF for the session tower: linear layers with ReLU between them, then length 1."""
    import numpy as np
    import pandas as pd

    layers = [(np.asarray(w, float), np.asarray(b, float)) for w, b in weights]

    def forward(vectors):
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, layers[0][0].shape[1]))
        for i, (w, b) in enumerate(layers):
            x = x @ w.T + b
            x = np.maximum(x, 0) if i + 1 < len(layers) else x
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list(x / np.where(norm > 0, norm, 1)))

    forward.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return F.pandas_udf(forward, "array<double>")


def item2vec(events: DataFrame, dim: int = 32, seed: int = 7, partitions: int = 4) -> DataFrame:
    """item_id, vec of every item from the order of items in sessions. Stands in for a dual encoder, which needs a library that isn't here."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    baskets = events.groupBy("session_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))
    model = Word2Vec(vectorSize=dim, minCount=1, maxIter=2, seed=seed, numPartitions=partitions, inputCol="items", outputCol="vec").fit(baskets)
    return model.getVectors().select(F.col("word").alias("item_id"), vector_to_array("vector").alias("vec"))
