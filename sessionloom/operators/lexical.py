"""Okapi BM25 as three small tables and a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import materialise


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda t: t != "")


class BM25:
    """Index of docs(doc_id, tokens): tf (doc_id, term, tf, dl), df (term, df, idf), and one row of n_docs and avgdl."""

    def __init__(self, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> None:
        if k1 <= 0 or not 0 <= b <= 1:
            raise ValueError("k1 must be positive, b between 0 and 1")
        self.k1, self.b = k1, b
        sized = docs.select("doc_id", "tokens", F.size("tokens").alias("dl"))
        # texts are cut once: all that follows reads the terms
        tf = sized.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
        self.tf = materialise(tf, "bm25-terms")
        terms = self.tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_terms"))
        self.stats = docs.agg(F.count("*").alias("n_docs")).crossJoin(terms).select("n_docs", F.try_divide(F.col("_terms"), F.col("n_docs")).alias("avgdl"))
        df = self.tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(self.stats))
        n, d = F.col("n_docs"), F.col("df")
        self.df = df.select("term", "df", F.ln((n - d + 0.5) / (d + 0.5) + 1).alias("idf"))

    def score(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id, score for queries(query_id, tokens); repeated query terms count once; documents without a term of it are absent."""
        terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
        met = terms.join(self.df, "term").join(self.tf, "term").crossJoin(F.broadcast(self.stats))
        tf, norm = F.col("tf"), self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl"))
        return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * tf * (self.k1 + 1) / (tf + norm)).alias("score"))

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
        return self.score(queries).where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
