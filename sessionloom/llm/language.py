"""Language identification by rank-order profiles.

The n-grams (1 to 3 characters, word ends marked) of a language are ranked by frequency; so are those of a document. The distance
to a language is the sum over the document's n-grams of how far they are out of place; the nearest language wins.

The profiles are learned from a bounded sample: about `max_docs` labelled documents of each language (all, where there are fewer), those
with the smallest hashes of doc_id.
Prediction reads every whole text, and no other column.

Null text or text without a letter: `und`, score 0. Null lang: not learned from. Repeated rows are predicted alike. Ties between languages go to the
first by code point; ties between n-grams by code. Nothing to learn from: all `und`. Empty table: empty result. Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, packed

#: Labelled documents per language that are learned from, about, where there are more; and ranks in a profile.
MAX_DOCS = 1500
RANKS = 400
UND = "und"
#: Documents below this score are rejected by the pipeline, beside those of no language.
MIN_SCORE = 0.05


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of a text: letters in lower case, anything else a word end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.where(letter, points, 0)
    points = np.concatenate([[0], points[letter | np.concatenate([[False], letter[:-1]])], [0]]).astype(np.uint64)
    two = points[:-1] << np.uint64(21) | points[1:]
    three = two[:-1] << np.uint64(21) | points[2:]
    # a gram that spans two words has its mark in the middle, and is none
    middle = points[1:-1] != 0
    codes = np.concatenate([points[points != 0], two[two != 0] | np.uint64(1 << 62), three[middle] | np.uint64(1 << 63)])
    codes.sort()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent codes, best first; of equals the smaller code."""
    if len(counts) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:ranks]


class Profiles:
    """Ranks of each language's n-grams; distance() and predict() for a text."""

    def __init__(self, profiles: dict[str, list[int]], ranks: int) -> None:
        self.ranks, self.languages, self.tables = ranks, sorted(profiles), []
        for lang in self.languages:
            codes = np.asarray(profiles[lang], np.uint64)
            order = np.argsort(codes)
            self.tables.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(*grams(text), self.ranks) if text else ()
        if not len(codes) or not self.languages:
            return UND, 0.0
        own, distances = np.arange(len(codes)), []
        for table, places in self.tables:
            at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
            distances.append(int(np.where(table[at] == codes, np.minimum(np.abs(places[at] - own), self.ranks), self.ranks).sum()))
        best = int(np.argmin(distances))
        return self.languages[best], 1 - distances[best] / (self.ranks * len(codes))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _partial(batches, ranks: int):
    """lang, gram, n of a task's rows, in parts of bounded size."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            texts = (batch.column(1)[i].as_py() for i, own in enumerate(langs) if own == lang)
            parts = [grams(t) for t in texts if t]
            if not parts:
                continue
            codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def learn(docs: DataFrame, max_docs: int = MAX_DOCS, ranks: int = RANKS) -> Profiles:
    """Profiles from docs(doc_id, text, lang): `ranks` n-grams for each language come to the driver, no more."""
    order = F.xxhash64(F.col("doc_id").cast("long"))
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text", order.alias("at"))
    # one number a language comes to the driver: the hash below which about max_docs of its documents lie
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({}, ranks)
    below = {lang: min((1 << 63) - 1, -(1 << 63) + (max_docs << 64) // n) for lang, n in sizes.items()}
    limits = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    texts = labelled.where(F.col("at") <= limits[F.col("lang")]).select("lang", "text")
    counts = arrow_map(texts, lambda b: _partial(b, ranks), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # codes are unsigned: those with the highest bit come last
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    rows = counts.withColumn("at", F.row_number().over(best)).where(F.col("at") <= ranks).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["at"])):
        profiles.setdefault(r["lang"], []).append(r["gram"] % (1 << 64))
    return Profiles(profiles, ranks)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for docs(doc_id, text). No exchange."""

    def predicted(batches):
        for batch in batches:
            said = [profiles.predict(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([s for s, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(rows, predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that have a language: not `und`, and a score of min_score at least. All columns stay. No exchange."""
    profiles, rows, at = learn(docs), packed(docs), docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            said = [profiles.predict(t.as_py()) for t in batch.column(0).field(at)]
            yield batch.filter(pa.array([lang != UND and score >= min_score for lang, score in said], pa.bool_()))

    return arrow_map(rows, kept, rows.schema).select("row.*")


def op3_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs))
