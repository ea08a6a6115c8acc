"""Mixing sources to target weights by capped water-filling.

Targets: the total is shared by weight; sources whose share exceeds `max_epochs` times their size are clamped there, the excess is shared again by
weight among the others, and so on until no source is above.
Sampling: a source at rate r = target / size takes every document floor(r) times, and once more the documents that come first in a seeded
order until the rest of the target is met. The order is a hash of doc_id and seed: reruns and other partitionings agree.
DataFrame functions only. Where a source's order is cut is found in two steps: sums over hash buckets, a bounded number for each source, then
the documents of the one bucket in which the cut lies; no source is sorted as a whole. Each row is then held against its source's cut where it lies,
so that no text moves, as long as there are at most FEW_SOURCES sources; beyond that, rows meet their source by an exchange.

Null text: size 0. Null source: a source of its own, the last. Null doc_id: hashed as an empty string. Repeated rows are mixed alike: rows
that agree in source, doc_id and size are taken equally often. A source of size 0 has target 0. Empty table: empty result. Other columns are kept by
mix() and ignored by quotas(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import dense_codes
from .common import join_spread, materialise, packed, quoted, words_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKETS = 4096
#: Hashes of a bucket.
WIDTH = (1 << 32) // BUCKETS
#: Sources whose cuts are broadcast: a hundred bytes or so each.
FEW_SOURCES = 20_000
_LAST = (1 << 63) - 1


def seeded_hash(doc_id: Column, seed: str) -> Column:
    """32 bits of MD5, as other engines compute it too."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key that is never null: its name behind a sign, nothing for a null one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """sizes(key, source_size), a row per source, with target. Each round of clamping is one pass over the sources; the driver holds one number, the level
    that a unit of weight gets."""
    numbered = dense_codes(sizes.withColumn("last", F.col("key") == ""), ["last", "key"], "place")
    weighted = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    table = materialise(weighted.withColumn("cap", max_epochs * F.col("source_size")).drop("last", "place"), "mix-sources")
    level, clamped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap") if clamped >= 0 else F.lit(False)
        r = table.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, F.col("cap"))).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == clamped or not r["weight"]:
            break
        level, clamped = float(r["total"] - (r["caps"] or 0)) / r["weight"], r["n"]
    return table.select("key", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, source: str, seed: str) -> dict[str, Column]:
    doc = F.col("doc_id").cast("long")
    return {"doc_id": doc, "key": source_key(F.col(quoted(source))), "size": F.size(words_of(F.col("text"))).cast("long"), "hash": seeded_hash(doc, seed)}


def _place() -> Column:
    """A row's place in the seeded order of its source; a null doc_id comes first."""
    return F.struct("hash", F.col("doc_id").isNotNull().alias("present"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "size")


def cuts(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """key, docs, source_size, target, whole, cut of rows(doc_id, key, size, hash), a table on disk; a table on disk with a row per source: each of its documents is taken `whole`
    times, and once more if its place is not after `cut`."""
    bucket = (F.col("hash") / WIDTH).cast("int")
    # up to BUCKETS rows for each source, however many documents it has
    sums = materialise(rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("inside"), F.count("*").alias("docs")), "mix-buckets")
    shares = targets(sums.groupBy("key").agg(F.sum("inside").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    shares = shares.withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    by_source = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.join(shares, "key").withColumn("before", F.coalesce(F.sum("inside").over(by_source), F.lit(0)))
    after = F.col("before") + F.col("inside")
    full, crossed = (F.col("extra") > 0) & (after <= F.col("extra")), (F.col("before") < F.col("extra")) & (after > F.col("extra"))
    once = [F.max(c).alias(c) for c in ("source_size", "target", "whole", "extra")]
    sources = placed.groupBy("key").agg(F.sum("docs").alias("docs"), *once, F.max(F.when(full, F.col("bucket"))).alias("last_full"), F.max(F.when(crossed, F.struct("bucket", "before"))).alias("crossed"))
    sources = materialise(sources, "mix-shares")
    # the documents of crossed buckets alone; equal places go together
    inner = sources.where(F.col("crossed").isNotNull()).select("key", F.col("crossed.bucket").alias("bucket"), F.col("crossed.before").alias("before"), "extra")
    groups = rows.withColumn("bucket", bucket).join(inner, ["key", "bucket"]).groupBy("key", "hash", "doc_id", "size").agg(F.sum("size").alias("n"), F.max("before").alias("before"), F.max("extra").alias("extra"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a document in whose middle the cut lies is taken if that comes nearer to the target
    taken = groups.withColumn("place", _place()).withColumn("upto", upto).where(2 * F.col("upto") - F.col("n") <= 2 * F.col("extra"))
    found = taken.groupBy("key").agg(F.max("place").alias("found"))
    whole_bucket = F.struct(((F.col("last_full") + 1).cast("long") * WIDTH - 1).alias("hash"), F.lit(True).alias("present"), F.lit(_LAST).alias("doc_id"), F.lit(_LAST).alias("size"))
    cut = F.coalesce("found", F.when(F.col("last_full").isNotNull(), whole_bucket))
    return materialise(sources.join(found, "key", "left").select("key", "docs", "source_size", "target", "whole", cut.alias("cut")), "mix-cuts")


def _with_copies(rows: DataFrame, sources: DataFrame, max_epochs: int) -> DataFrame:
    """rows with their source's numbers and `copies`."""
    met = rows.join(F.broadcast(sources.drop("docs")), "key") if sources.count() <= FEW_SOURCES else join_spread(rows, sources, "key", "docs")
    more = F.coalesce(_place() <= F.col("cut"), F.lit(False)).cast("int")
    return met.withColumn("copies", F.least(F.col("whole") + more, F.lit(max_epochs)))


def quotas(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row per row of docs(doc_id, text, source)."""
    rows = materialise(docs.select(*[c.alias(n) for n, c in _sized(docs, source, seed).items()]), "mix-sizes")
    met = _with_copies(rows, cuts(rows, weights, max_epochs), max_epochs)
    return met.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Rows of docs, each as often as the mix takes it."""
    sized = packed(docs, **_sized(docs, source, seed))
    rows = materialise(sized.drop("row"), "mix-sizes")
    met = _with_copies(sized, cuts(rows, weights, max_epochs), max_epochs)
    return met.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source AS host, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 8))::BIGINT AS hash FROM documents
), s AS (
  SELECT host, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY host NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM d GROUP BY host
), c AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER o AS place FROM c WINDOW o AS (ORDER BY cap / weight, host NULLS LAST)
), t AS (
  SELECT host, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM l WHERE NOT level * weight > cap ORDER BY place LIMIT 1) * weight), cap::DOUBLE) AS target FROM l
), m AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.host ORDER BY hash, doc_id NULLS FIRST, size) AS upto, sum(size) OVER (PARTITION BY d.host, hash, doc_id, size) AS n
  FROM d JOIN t ON d.host IS NOT DISTINCT FROM t.host
), n AS (
  SELECT *, least(whole + CASE WHEN target - whole * source_size > 0 AND 2 * upto - n <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END, {MAX_EPOCHS})::INT AS copies FROM m
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM n
"""
